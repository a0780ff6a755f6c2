"""Format-preserving pseudonyms for personal data. DataFrame functions only.

Plan: one projection, no shuffle. One pattern finds candidates in the whole text; each is validated
(Luhn sum, octets, groups, calendar, mod 97, number blocks, numbering plan) and replaced by a keyed permutation of
itself within its format, so equal values have equal pseudonyms in all documents, and different
values different ones. The permutation is a Feistel network of ten rounds with SHA-512 under the
key: on digit strings (cards keep their Luhn sum, phones and social security numbers their punctuation),
on the two halves of an IPv4 address, on the 32 hexadecimal digits of an IPv6 address (written in full), on the days 1900-01-01 to
2099-12-31 (walking the cycle past numbers that are no day), and on letters and digits of e-mail addresses (the
local part, and the domain but for its last label) and secrets. A bare hexadecimal string is a secret only after a
word that says so: checksums and commit hashes stay. Phones must have the form of the numbering plan: area and
exchange of a ten-digit number begin with 2 to 9, international numbers have 8 to 15 digits; ten digits in a row are a
phone only after a word that says so.

Defined results: a null text stays null with counts 0; an empty text stays empty; candidates that
do not validate stay as they are; repeated rows get equal results; an empty table gives an empty
result; other columns pass through (those named like a result column give way).
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Two factors whose product is the least over DAYS by at most a few hundredths: 271 * 270 = 73170.
DAY_HALVES = (271, 270)

#: Every alternative is bounded and starts only where its run starts, so a scan is linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9_-])|(?=[0-9a-f]{32})(?<=(?i:token|secret|key|passw(?:or)?d|pwd|auth|bearer|credential|signature)[\s\"':=]{1,6})[0-9a-f]{32,128}(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])|(?<![0-9A-Za-z+(])\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9A-Za-z]|[ .-]?[0-9])|(?=[2-9][0-9]{9})(?<=\b(?i:phone|tel|telephone|call|mobile|cell|fax)[.:# ]{1,3})[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
}
KINDS = list(PATTERNS)
#: What a match alone looks like, where its pattern also looks at what stands before.
ALONE = PATTERNS | {"phone": PATTERNS["phone"] + "|[2-9][0-9]{2}[2-9][0-9]{6}", "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,128}"}
#: Setting that holds the key of the registered query.
KEY_SETTING = "spark.quillspark.pseudonymKey"
#: What every match has: a digit, an ``@``, a secret's mark or length, or seven groups with colons. Texts without are not searched.
ANCHOR = r"[0-9@]|gh[pousr]_|sk-[A-Za-z0-9]|A[KS]IA|[a-f]{32}|(?:[A-Fa-f]{1,4}:){7}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _prf(key: str, label: str, k: Column, half: Column) -> Column:
    """128 hexadecimal digits of a round."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), k.cast("string"), half.cast("string")), 512)


def _number(prf: Column, at: Column | int = 0) -> Column:
    """A number under 2^28 from the seven digits of a PRF value after position 4 * at (cyclic in 32 places)."""
    start = (F.pmod(F.lit(at) if isinstance(at, int) else at, F.lit(31)) * 4 + 1).cast("int")
    return F.conv(F.substr(prf, start, F.lit(7)), 16, 10).cast("long")


def _shift(s: Column, prf: Column, hexadecimal: bool) -> Column:
    """Every digit or letter of s moved within its own alphabet by the PRF's number for its place."""

    def one(i: Column) -> Column:
        c, out = F.substr(s, i, F.lit(1)), None
        alphabets = ["0123456789abcdef"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            moved = F.substr(F.lit(a), (F.pmod(at - 1 + _number(prf, i), F.lit(len(a))) + 1).cast("int"), F.lit(1))
            out = F.when(at > 0, moved) if out is None else out.when(at > 0, moved)
        return out.otherwise(c)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise("")


def feistel_text(s: Column, key: str, label: str, hexadecimal: bool = False) -> Column:
    """Permutes texts of one format (length and kind of every character): two halves in turn are
    shifted by what the other half says."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), cut).alias("l"), F.substr(s, cut + 1, F.length(s)).alias("r"))

    def step(x: Column, k: Column) -> Column:
        moved = _shift(x.l, _prf(key, label, k, x.r), hexadecimal)
        return F.struct(x.r.alias("l"), moved.alias("r"))

    # an even number of rounds: the halves are back in their places
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda x: F.concat(x.l, x.r))
    # a text of one character has an empty half: the rounds are shifts by the key alone
    return done


def feistel_number(l: Column, r: Column, m: int, n: int, key: str, label: str) -> Column:  # noqa: E741
    """Permutes pairs (l below m, r below n), as a struct."""

    def step(x: Column, k: Column) -> Column:
        a = F.pmod(x.l + _number(_prf(key, label, k, x.r)), F.lit(m))
        return F.struct(a.alias("l"), F.pmod(x.r + _number(_prf(key, label, -k, a)), F.lit(n)).alias("r"))

    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(form: Column, digits: Column, skip: Column | int = 0) -> Column:
    """form with its digits after the first ``skip`` replaced by those of digits, in order."""
    skip = F.lit(skip) if isinstance(skip, int) else skip

    def one(i: Column) -> Column:
        c, nth = F.substr(form, i, F.lit(1)), F.length(digits_of(F.substr(form, F.lit(1), i))) - skip
        return F.when(c.between("0", "9") & (nth > 0), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; doubled: 1 if the last digit is doubled, 0 if the one before."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1 - doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(s: Column) -> Column:
    """An IBAN's remainder, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(moved, i, F.lit(1))) - 1
        return F.pmod(F.when(v < 10, rest * 10).otherwise(rest * 100) + v, F.lit(97)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, F.lit("@"))
    last = F.length(m) - F.length(F.substring_index(m, ".", -1))  # the dot before the last label
    local, domain = F.substr(m, F.lit(1), at - 1), F.substr(m, at + 1, last - at - 1)
    return F.concat(feistel_text(local, key, "email"), F.lit("@"), feistel_text(domain, key, "domain"), F.substr(m, last, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    hexa = m.rlike("^[0-9a-f]+$")
    mark = F.regexp_extract(m, "^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0)
    rest = F.substr(m, F.length(mark) + 1, F.length(m))
    return F.when(hexa, feistel_text(m, key, "secret", hexadecimal=True)).otherwise(F.concat(mark, feistel_text(rest, key, "secret")))


def _iban(m: Column, key: str) -> Column:
    country, body = F.substr(m, F.lit(1), F.lit(2)), feistel_text(F.substr(m, F.lit(5), F.length(m)), key, "iban")
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.when(_mod97(m) == 1, F.concat(country, check, body))


def _day(m: Column) -> tuple[Column, Column]:
    iso, slash = m.rlike("^[0-9]{4}-"), m.contains("/")
    read = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy"), F.try_to_date(F.translate(m, "/", "."), "MM.dd.yyyy")))
    form = F.when(iso, F.lit("iso")).when(F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy").isNotNull(), F.when(slash, F.lit("d/")).otherwise(F.lit("d."))).otherwise(F.when(slash, F.lit("m/")).otherwise(F.lit("m.")))
    return read, form


def _date(m: Column, key: str) -> Column:
    read, form = _day(m)
    index = F.date_diff(read, F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_HALVES

    def walk(x: Column, _: Column) -> Column:
        y = feistel_number(F.floor(F.abs(x) / b), F.pmod(F.abs(x), F.lit(b)), a, b, key, "date")
        # below zero: not yet a day (one is added to keep zero apart)
        stepped = (y.l * b + y.r).cast("long")
        return F.when(x > 0, F.when(stepped < DAYS, -stepped - 1).otherwise(stepped)).otherwise(x)

    # positive: still to walk; a permutation leaves the numbers past DAYS after at most as many steps as there are
    first = feistel_number(F.floor(index / b), F.pmod(index, F.lit(b)), a, b, key, "date")
    start = (first.l * b + first.r).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - DAYS)), F.when(start < DAYS, -start - 1).otherwise(start), walk)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (-walked - 1).cast("int"))
    text = F.when(form == "iso", F.date_format(day, "yyyy-MM-dd")).when(form == "d/", F.date_format(day, "dd/MM/yyyy")).when(form == "d.", F.date_format(day, "dd.MM.yyyy"))
    text = text.when(form == "m/", F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "MM.dd.yyyy"))
    return F.when(index.between(0, DAYS - 1), text)


def _ip(m: Column, key: str) -> Column:
    part = [F.split_part(m, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    ok = part[0].between(0, 255) & part[1].between(0, 255) & part[2].between(0, 255) & part[3].between(0, 255)
    y = feistel_number(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, key, "ip")
    text = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string"))
    return F.when(ok, F.aggregate(F.array(y), F.lit(""), lambda _, v: F.concat_ws(".", text(v.l), text(v.r))))


def _ipv6(m: Column, key: str) -> Column:
    """An address has one pseudonym in all its notations, written in full. Short forms need three groups and a digit."""
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    short = m.contains("::")
    ok = ~short | ((F.size(groups(m)) >= 3) & (F.size(groups(m)) <= 7) & m.rlike("[0-9]"))
    left, right = groups(F.substring_index(m, "::", 1)), F.when(short, groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>"))
    all_eight = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    whole = F.array_join(F.transform(all_eight, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    made = feistel_text(whole, key, "ipv6", hexadecimal=True)
    # the permuted digits are made once and bound to a name
    return F.when(ok, F.aggregate(F.array(made), F.lit(""), lambda _, v: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.substr(v, i, F.lit(4))), ":")))


def _valid_ssn(d: Column) -> Column:
    area = F.substr(d, F.lit(1), F.lit(3))
    return (area != "000") & (area != "666") & (area < "900") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000")


def _ssn(m: Column, key: str) -> Column:
    d = digits_of(m)
    start = F.struct(d.alias("v"), F.lit(False).alias("ok"))

    def walk(x: Column, _: Column) -> Column:
        y = F.when(x.ok, x.v).otherwise(feistel_text(x.v, key, "ssn"))
        return F.struct(y.alias("v"), (x.ok | _valid_ssn(y)).alias("ok"))

    # nine of ten numbers are valid; 40 invalid ones in a row do not occur in practice, and would stay a permutation
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, walk, lambda x: x.v)
    return F.when(_valid_ssn(d), refill(m, walked))


def _phone(m: Column, key: str) -> Column:
    """The country code stays: what stands before the first separator, of numbers in a row two digits (one for 1)."""
    d, plus, plan = digits_of(m), F.startswith(m, F.lit("+")), "^[2-9][0-9]{2}[2-9][0-9]{6}$"
    home = ~plus | F.startswith(d, F.lit("1"))
    code = F.length(F.regexp_extract(m, "^[+]([0-9]{1,3})[ .-]", 1))
    keep = F.when(home, F.greatest(F.length(d) - 10, F.lit(0))).when(code > 0, code).otherwise(2)
    planned = F.when(home, (F.length(d) <= 11) & F.right(d, F.lit(10)).rlike(plan)).otherwise(F.length(d).between(8, 15))
    # walks the permutation until the number has the plan's form again, as eight of ten pairs of digits have
    start = F.struct(F.substr(d, keep + 1, F.length(d)).alias("v"), F.lit(False).alias("ok"))

    def walk(x: Column, _: Column) -> Column:
        y = F.when(x.ok, x.v).otherwise(feistel_text(x.v, key, "phone"))
        return F.struct(y.alias("v"), (x.ok | ~home | y.rlike(plan)).alias("ok"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, walk, lambda x: x.v)
    return F.when(planned, refill(m, walked, keep))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body, 1), F.lit(10)), F.lit(10)).cast("string")
    ok = (F.pmod(_luhn_sum(d, 0), F.lit(10)) == 0) & ~d.rlike("^0+$")
    return F.when(ok, F.aggregate(F.array(F.concat(body, check)), m, lambda form, digits: refill(form, digits)))


MAKERS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ipv6": _ipv6, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and a count ``n_<kind>`` of replacements for each kind."""

    def replaced(m: Column) -> Column:
        out = None
        for kind in KINDS:
            fits, made = m.rlike(f"^(?:{ALONE[kind]})$"), F.struct(F.lit(kind).alias("kind"), MAKERS[kind](m, key).alias("out"))
            out = F.when(fits, made) if out is None else out.when(fits, made)
        return out

    text = F.col(text_col)
    counts = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c not in counts]
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), replaced(m).alias("x")))
    marked = docs.select(*rest, F.when(text.rlike(ANCHOR), found).alias("__found"))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, "__found", lambda p, f: F.concat(p, F.coalesce(f.x.out, f.m, F.lit("")))), "")
    done = F.when(F.size("__found") > 0, joined).otherwise(text)

    def times(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("__found", lambda f: (f.x.kind == kind) & f.x.out.isNotNull())), F.lit(0))

    n = [F.greatest(times(kind), F.lit(0)).cast("long").alias(name) for kind, name in zip(KINDS, counts)]
    return marked.select(*[done.alias(c) if c == text_col else F.col(c) for c in rest], *n)


def session_key(spark: SparkSession) -> str:
    """The key that the setting holds; where it is unset, a secret random one, set for the rest of the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs.select("doc_id", "text"), key=session_key(spark))
