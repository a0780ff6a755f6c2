"""Sentences as the SQL of text_sentences cuts them."""

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import TABLES, compare

from quillspark import catalog


def test_digits_stay_and_blanks_go(spark, sf_dir, tmp_path):
    """The place of a sentence was given to trim as the characters to take off: 0 from the first, 1 from the second, ..."""
    texts = ["0997 | ab. 101 cd. 2.  3 ", "  000. 0 . x", "a\x1eb. c", "?\x0b b", "a.\n\n b \r c!\td", "", None]
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    (tmp_path / "documents.parquet").unlink()
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    compare(catalog.queries()["text_sentences"](spark, str(tmp_path)), catalog.oracle_sql()["text_sentences"], str(tmp_path))
