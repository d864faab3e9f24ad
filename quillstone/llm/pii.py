r"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust a score (operator 2, native).

Only SQL functions run here. For each kind the expression's matches (``regexp_extract_all``) and the gaps
between them (``split``) give code-point positions through running lengths; matches that fail their
validator are dropped and not retried. Every kind is one linear pass of a backtracking-free expression:
possessive repeats, and a look-behind that keeps a search from starting again inside a run
(``\G`` admits the place where the last match ended). Sums and contexts come from the gaps alone, and redaction works on an
array of characters, so long texts with many matches take time in proportion.

Base kinds: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits).
The method adds: iban (its country's length, mod 97), key (access-key identifiers), ssn (only with a context word nearby)
and secret (a value with a digit given to a password or token).
A span's score is its kind's, raised by 0.1 if a context word stands within ``NEAR`` characters before or after it (up to
the neighbouring match of the kind).

Scale: one projection without a shuffle; a document never meets another, so skewed sources do not matter.

Defined results: a null text counts as empty; an empty text has no spans and the digest of the empty
string; very long ones are searched whole. Spans of different kinds may overlap; redaction merges them. Repeated rows each
get their row, null doc_ids too; other columns pass through, but for one of the output's name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, unused

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA", 30: "JO KW MU", 31: "MT", 32: "LC",
}
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?i:password|passwd|secret|token|api[_-]?key) ?[=:] ?[\x22']?[A-Za-z0-9_/+-]{8,}"

BASE = ("email", "ip", "card", "phone")
#: kind -> (expression, cheap necessary condition, score without context, context words)
KINDS = {
    "email": (EMAIL, "@", 0.9, "mail|contact|write|address"),
    "ip": (IP, ".", 0.7, "host|server|address|addr|login"),
    "card": (CARD, None, 0.8, "card|visa|credit|debit|payment|karte|carte|tarjeta"),
    "phone": (PHONE, "+", 0.7, "phone|call|tel|mobile|fax"),
    "iban": (IBAN, None, 0.9, "iban|bank|account|konto|compte|cuenta"),
    "key": (KEY, "IA", 0.9, "key|access|aws|secret"),
    "ssn": (SSN, "-", 0.4, "ssn|social|security|insurance"),
    "secret": (SECRET, None, 0.8, "login|user|auth|account"),
}
#: Characters on either side that count as near.
NEAR = 48


def _digits(s: Column) -> Column:
    return F.translate(s, " -().+", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum holds; up to 19 digits."""
    d = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(1, 21):  # from the left; the last of 20 places is not doubled
        v = F.substring(d, i, 1).cast("int")
        total = total + (v if i % 2 == 0 else F.when(v > 4, v * 2 - 9).otherwise(v * 2))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10 holds: four first characters to the end, letters as 10 to 35, remainder 1."""
    s = F.translate(iban, " ", "")
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def fold(t: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.conv(F.substring(t, i, F.lit(1)), 36, 10).cast("int"))
        return F.aggregate(codes, F.lit(0), lambda a, c: (a * F.when(c > 9, 100).otherwise(10) + c) % 97) == 1

    return let(turned, fold)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return let(_digits(s), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "iban":
        return mod97(s)
    if kind == "secret":
        return s.rlike("[0-9]")
    return F.lit(True)


def _located(text: Column, kind: str) -> Column:
    """array<struct<start,kind,rank,end,score>> of one kind."""
    pattern, needs, score, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    kind_type = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"
    none = F.array().cast(kind_type)

    def place(found: Column) -> Column:
        def build(x: Column) -> Column:  # x: found, gaps, lengths of gap and match up to each match's end, and of all blocks of 256 before
            def one(m: Column, i: Column) -> Column:
                block = F.floor(i / 256).cast("int")
                end = F.element_at(x["before"], block + 1) + F.aggregate(F.slice(x["sums"], block * 256 + 1, i - block * 256 + 1), F.lit(0), lambda a, v: a + v)
                around = F.lower(F.concat(F.right(F.element_at(x["gaps"], i + 1), F.lit(NEAR)), F.lit(" "), F.left(F.element_at(x["gaps"], i + 2), F.lit(NEAR))))
                near = around.rlike(words)
                return F.struct(
                    (end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
                    F.when(near, score + 0.1).otherwise(score).cast("double").alias("score"), (_valid(kind, m) & (near if kind == "ssn" else F.lit(True))).alias("ok"),
                )

            kept = F.filter(F.transform(x["found"], one), lambda s: s["ok"])
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score")))

        add = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)

        def summed(x: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.size(x["sums"]) - 1, F.lit(256)), lambda b: add(F.slice(x["sums"], b + 1, F.lit(256))))
            before = let(blocks, lambda b: F.transform(b, lambda _, k: add(F.slice(b, F.lit(1), k))))
            return F.struct(x["found"].alias("found"), x["gaps"].alias("gaps"), x["sums"].alias("sums"), before.alias("before"))

        def with_gaps(gaps: Column) -> Column:
            sums = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
            return F.struct(found.alias("found"), gaps.alias("gaps"), sums.alias("sums"))

        return F.when(F.size(found) > 0, let(let(let(F.split(text, pattern, -1), with_gaps), summed), build)).otherwise(none)

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    if needs:
        return F.when(F.contains(text, F.lit(needs)), every).otherwise(none)
    return F.when(text.rlike("[0-9]"), every).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with an array of (start, rank, kind, end, score), sorted by start, then kind."""
    col = F.coalesce(F.col(text), F.lit(""))
    spans = let(col, lambda t: F.array_sort(F.concat(*[_located(t, k) for k in KINDS])))
    return docs.withColumn(out, spans)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every stretch of overlapping spans by ``<KIND>``; n_chars, if there, follows. A null text stays null."""

    column = unused("__pii", docs.columns)
    found = find_spans(docs, text, column)

    def replaced(x: Column) -> Column:  # x: characters, spans, and the largest end of all blocks of 256 spans before
        def one(s: Column, i: Column) -> Column:
            block = F.floor(i / 256).cast("int")
            ends = F.transform(F.slice(x["spans"], block * 256 + 1, i - block * 256), lambda v: v["end"])
            at = F.greatest(F.element_at(x["before"], block + 1), F.coalesce(F.array_max(ends), F.lit(0)))
            gap = F.array_join(F.slice(x["chars"], at + 1, F.greatest(s["start"] - at, F.lit(0))), "")
            return F.when(s["start"] >= at, F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

        last = F.array_max(F.transform(x["spans"], lambda v: v["end"]))
        tail = F.array_join(F.slice(x["chars"], last + 1, F.size(x["chars"])), "")
        return F.concat(F.array_join(F.transform(x["spans"], one), ""), tail)

    def with_blocks(spans: Column) -> Column:
        most = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(256)), lambda b: F.array_max(F.transform(F.slice(spans, b + 1, F.lit(256)), lambda v: v["end"])))
        before = let(most, lambda m: F.transform(m, lambda _, k: F.coalesce(F.array_max(F.slice(m, F.lit(1), k)), F.lit(0))))
        return F.struct(F.split(F.col(text), "").alias("chars"), spans.alias("spans"), before.alias("before"))

    some = F.size(column) > 0
    out = found.withColumn(text, F.when(some, let(let(F.col(column), with_blocks), replaced)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs).drop("text")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(_joined(F.filter("pii", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),  # of the spans in order, in per cent
    )


def _kind_sql(kind: str, rank: int, pattern: str, keep: str) -> str:
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, e, CASE WHEN regexp_matches(around, '{KINDS[kind][3]}') THEN {round(100 * KINDS[kind][2]) + 10} ELSE {round(100 * KINDS[kind][2])} END AS score FROM (
    SELECT doc_id, lower(right(g[i], {NEAR}) || ' ' || left(g[i + 1], {NEAR})) AS around, t, CAST(list_sum(list_slice(gl, 1, i)) + coalesce(list_sum(list_slice(ml, 1, i - 1)), 0) AS BIGINT) AS s, m[i] AS v, s + ml[i] AS e
    FROM (SELECT *, list_transform(g, lambda x: length(x)) AS gl, list_transform(m, lambda x: length(x)) AS ml, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d))
  ) WHERE {keep}"""


_LUHN = (
    "length(regexp_replace(v,'[ -]','','g')) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, 21), lambda k: "
    "CASE WHEN k % 2 = 0 THEN CAST(substr(lpad(regexp_replace(v,'[ -]','','g'),20,'0'), k, 1) AS INT) ELSE "
    "(CAST(substr(lpad(regexp_replace(v,'[ -]','','g'),20,'0'), k, 1) AS INT) * 2 + 0) - CASE WHEN CAST(substr(lpad(regexp_replace(v,'[ -]','','g'),20,'0'), k, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_IP_OK = "regexp_full_match(v, '(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\\.){3}0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})')"
_NEAR_SQL = f"regexp_matches(around, '{KINDS['ssn'][3]}')"
_EDGE = "NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, e + 1, 1), '[A-Za-z0-9]')"

#: The same kinds in DuckDB; its expressions have no look-around, so neighbours are looked at afterwards.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS (
  {_kind_sql('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_kind_sql('ip', 1, r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', _IP_OK)}
  UNION ALL {_kind_sql('card', 2, r'[0-9](?:[ -]?[0-9])+', _LUHN)}
  UNION ALL {_kind_sql('phone', 3, r'\+[0-9][ ().0-9-]+[0-9]', "length(regexp_replace(v,'[^0-9]','','g')) BETWEEN 10 AND 15")}
  UNION ALL {_kind_sql('iban', 4, rf'\b(?:{_IBANS})\b', "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v,' ',''),5) || substr(replace(v,' ',''),1,4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1")}
  UNION ALL {_kind_sql('key', 5, r'(?:AKIA|ASIA)[A-Z0-9]{16}', _EDGE)}
  UNION ALL {_kind_sql('ssn', 6, r'[0-9]{3}-[0-9]{2}-[0-9]{4}', _NEAR_SQL + " AND NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, e + 1, 1), '[0-9-]')")}
  UNION ALL {_kind_sql('secret', 7, SECRET.replace("'", "''"), "regexp_matches(v, '[0-9]')")}
)
SELECT d.doc_id,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank), '') AS scores
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
