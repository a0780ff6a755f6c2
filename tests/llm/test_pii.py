"""Pseudonyms over thousands of texts made from parts that are known: every planted value is replaced within its format, equal
values alike and different ones differently, and all else stays."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from test_operators import luhn

from quillspark.llm import pii

LETTERS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def pick(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def card(rng):
    body = "4" + pick(rng, "0123456789", 14)
    return next(body + c for c in "0123456789" if luhn(body + c))


def iban(rng):
    body = pick(rng, "0123456789", 18)
    rest = int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    return f"DE{98 - rest:02d}{body}"


def ten(rng):
    return pick(rng, "23456789", 1) + pick(rng, "0123456789", 2) + pick(rng, "23456789", 1) + pick(rng, "0123456789", 6)


def phone(rng):
    d = ten(rng)
    return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"+1 {d[:3]} {d[3:6]} {d[6:]}", f"+1{d}", f"+44 {d[:2]} {d[2:6]} {d[6:]}", f"+44{d}"])


MAKE = {
    "email": lambda rng: f"{pick(rng, LETTERS, 6)}.{pick(rng, LETTERS, 4)}@{pick(rng, LETTERS, 7)}.org",
    "secret": lambda rng: rng.choice([f"ghp_{pick(rng, LETTERS, 36)}", f"sk-{pick(rng, LETTERS, 24)}", f"AKIA{pick(rng, 'ABCDEFGHIJ', 16)}", f"ghp_{pick(rng, LETTERS + '0123456789', 36)}"]),
    "iban": iban, "card": card, "phone": phone,
    "date": lambda rng: f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
    "ip": lambda rng: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    "ipv6": lambda rng: ":".join(pick(rng, HEX, 4) for _ in range(8)),
    "ssn": lambda rng: f"{rng.randint(100, 665)}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
}
#: What stays, however it looks: no valid number, no secret, no word that says so.
CLEAN = ["version 1.2.3", "999.1.1.1", "2023-02-30", "000-12-3456", "4111111111111112", "2125550199", "123-456-7890", "12:30:45", "a@b", "sk-short", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "XX00ABCDEFGHIJKLMNOP", "room 101"]


def test_planted_values_are_replaced_and_all_else_stays(spark):
    rng = random.Random(8)
    pool = {k: [make(rng) for _ in range(150)] for k, make in MAKE.items()}
    texts = [[(rng.choice(CLEAN), None) if rng.random() < 0.3 else (pick(rng, LETTERS, 5), None) if rng.random() < 0.5 else (rng.choice(pool[k := rng.choice(list(pool))]), k) for _ in range(rng.randint(1, 12))] for _ in range(3000)]
    rows = spark.createDataFrame([(n, " | ".join(x for x, _ in t)) for n, t in enumerate(texts)], "doc_id long, text string")
    names, shape = defaultdict(set), lambda s: re.sub("[0-9]", "0", re.sub("[a-f0-9]", "0", s) if ":" in s else re.sub("[a-z]", "a", s))
    for r in pii.pseudonymise(rows, "a key").collect():
        parts = r.text.split(" | ")
        assert len(parts) == len(texts[r.doc_id])
        for (was, kind), now in zip(texts[r.doc_id], parts):
            if kind is None:
                assert now == was
            else:
                names[kind, was].add(now)
                assert now != was
                if kind not in ("secret", "email"):
                    assert (re.sub("[0-9]", "0", now) == re.sub("[0-9]", "0", was)) if kind not in ("ip", "ipv6") else shape(now).count(":") == was.count(":")
                if kind == "card":
                    assert luhn(now)
                if kind == "secret":
                    assert re.match("ghp_|sk-|AKIA", was)[0] == re.match("ghp_|sk-|AKIA", now)[0] and len(was) == len(now)
        assert {k: r[f"n_{k}"] for k in MAKE} == {k: Counter(k for _, k in texts[r.doc_id])[k] for k in MAKE}
    assert all(len(v) == 1 for v in names.values())
    for kind in MAKE:
        mine = [next(iter(v)) for (k, _), v in names.items() if k == kind]
        assert len(set(mine)) == len(mine)


def test_what_a_text_holds_besides_changes_nothing(spark):
    found = ["ghp_" + "abcdefghij" * 3 + "klmnop", "sk-" + "abcdefgh" * 3, "token: " + "abcdef" * 6, "AKIA" + "ABCDEFGH" * 2, "ab:cd:ef:ab:cd:ef:ab:cd", "a@b.org"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame([(x + more,) for x in found for more in ("", " 7")], "text string"), "k").collect()]
    assert all(a + " 7" == b and a != x for x, a, b in zip(found, got[::2], got[1::2]))


def test_notations_of_one_value_have_one_pseudonym(spark):
    texts = ["2001:db8::1", "2001:0db8:0:0:0:0:0:1", "2001:0DB8:0000:0000:0000:0000:0000:0001", "+44 20 7946 0958", "+442079460958", "+1 212-555-0199", "(212) 555-0199", "phone: 2125550199", "+12125550199"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame([(x,) for x in texts], "text string"), "k").collect()]
    assert len(set(got[:3])) == 1 and re.fullmatch("[0-9a-f]{4}(:[0-9a-f]{4}){7}", got[0])
    digits = [re.sub("[^0-9]", "", x) for x in got[3:]]
    assert digits[0] == digits[1] != "442079460958" and len({d[-10:] for d in digits[2:]}) == 1 and digits[2][-10:] != "2125550199"


def test_key_is_secret_where_none_is_set(spark):
    old = spark.conf.get(pii.KEY_SETTING, None)
    try:
        spark.conf.unset(pii.KEY_SETTING)
        key = pii.session_key(spark)
        assert len(key) == 64 and pii.session_key(spark) == key
        spark.conf.unset(pii.KEY_SETTING)
        assert pii.session_key(spark) != key
    finally:
        spark.conf.unset(pii.KEY_SETTING)
        if old:
            spark.conf.set(pii.KEY_SETTING, old)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a@b.org", 5, "kept")], "doc_id long, text string, n_email long, kind string")
    r = pii.pseudonymise(rows.withColumn("x", F.lit(1)), "k").first()
    assert (r.n_email, r.kind, r.x) == (1, "kept", 1)
