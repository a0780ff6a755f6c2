"""Sections of files read in many splits against a parse of the whole file."""

import random
import re

import pytest

from quillspark.operators import markdown as M


def parse(content):
    lines, fenced, heads = content.split("\n"), False, []
    for n, line in enumerate(lines, 1):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#") and (m := re.match(r"^(#{1,6})\s+(.+)$", s)):
            heads.append((n, len(m[1]), m[2].strip()))
    out = []
    for k, (n, level, title) in enumerate(heads):
        end = heads[k + 1][0] - 1 if k + 1 < len(heads) else len(lines)
        parent = next((a for a, b, _ in reversed(heads[:k]) if b < level), None)
        out.append((n, level, title, parent, "\n".join(lines[n - 1 : end]).strip()))
    return out


def content(rng, n):
    parts = ["# One", "## Two  ", "###### Six", "####### seven", "#no", "  # indented", "```", "  ```python", "text", "", "   ", "# É ü", "word # not", "# "]
    return "\n".join(rng.choice(parts) + (f" {k}" if rng.random() < 0.5 else "") for k in range(n))


@pytest.mark.parametrize("split", [64, 1000, 10**7])
def test_as_a_whole_parse(spark, tmp_path, split):
    rng, old = random.Random(split), {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = {}
    for k in range(4):
        text = content(rng, [0, 3, 120, 400][k])
        (tmp_path / f"f{k}.md").write_text(text)
        want[f"f{k}.md"] = parse(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = M.read_lines(spark, f"file://{tmp_path}/*.md")
        assert split > 5000 or lines.select("id", "block").distinct().count() > 5
        got = M.sections(lines).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_file = {}
    for r in sorted(got, key=lambda r: r.line):
        by_file.setdefault(r.id.rsplit("/", 1)[1], []).append((r.line, r.level, r.title, r.parent, r.body))
    assert by_file == {k: v for k, v in want.items() if v}
