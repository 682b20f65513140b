"""Secret scans, in DataFrame functions only.

Three rules give base spans. The method adds tokens of sixteen characters and more that look random:
two character Markov models, one of random strings and one of ordinary identifiers, are trained from
labelled tokens, and a token whose log-likelihood ratio passes a threshold is a span of kind
`markov`. Labels come from the rules: a token that overlaps a base span is a random string, one of
letters without a digit or of digits alone is an ordinary identifier, and any other has no label and
is only scored. Pair counts cover all labelled tokens of all texts and are combined before the
shuffle; a model is at most ALPHABET squared numbers, which is what passes through the driver. The
random model is mixed with equal chances, so that random strings of other alphabets count too.

Texts are read once into a narrow stored table of base spans and tokens with their places; training
and scoring read that.

Defined cases: null and empty texts have no spans. Repeated rows and ties are judged row by row.
Without base spans the random model is the mixture's equal chances; without any token nothing is
scored. An empty table gives no rows. Other columns are left out, except by `redact_documents`,
which passes them through. Very long texts, texts of very many matches and very long tokens take
work in proportion to their length: running places come from blocks, never from growing arrays.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import free_name, table
from tallystone.session import materialize

# The base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BACK_OFF = 10.0
UNIT = 10_000  # log ratios are whole numbers of this fraction, so that sums are exact
# A token is random if its ratio is e^10 and each pair speaks for it by e^0.25 on average.
MIN_TOTAL, MIN_EACH = 10 * UNIT, UNIT // 4
MASK = "[SECRET]"
BLOCK, FEW_SPANS = 256, 32
PLACES = "array<struct<start:int,end:int,text:string>>"


def bind(value: Column, then) -> Column:
    """Evaluate once what a function of columns uses several times or inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, combine) -> Column:
    """Sums, maxima or minima of the values up to each place.

    Arrays grow only within blocks of BLOCK entries, so the work is linear in the text.
    """

    def along(block: Column) -> Column:
        def grow(state: Column, v: Column) -> Column:
            last = F.get(state, F.size(state) - 1)
            return F.array_append(state, F.when(F.size(state) == 0, v).otherwise(combine(last, v)))

        return F.aggregate(block, F.array().cast("array<int>"), grow)

    def carried(inner: Column) -> Column:
        ends = along(F.transform(inner, lambda b: F.element_at(b, -1)))
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(ends, 1, F.size(inner) - 1))
        onward = lambda b, base: F.transform(b, lambda v: F.when(base.isNull(), v).otherwise(combine(base, v)))
        return F.flatten(F.zip_with(inner, before, onward))

    def blocks(x: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: b * BLOCK + 1)
        return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(
            bind(F.transform(starts, lambda b: along(F.slice(x, b, F.lit(BLOCK)))), carried)
        )

    return bind(values, blocks)


def plus(a: Column, b: Column) -> Column:
    return a + b


def placed(text: Column, pattern: str) -> Column:
    """All matches with their places, from the matches and the pieces between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # One more piece than matches.
    paired = F.zip_with(hits, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("text")))
    sized = F.filter(paired, lambda x: x["text"].isNotNull())

    def found(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: y["gap"] + F.length(y["text"])), plus)
        return F.zip_with(
            x, ends, lambda y, end: F.struct((end - F.length(y["text"])).alias("start"), end.alias("end"), y["text"].alias("text"))
        )

    return F.when(text.rlike(pattern), bind(sized, found)).otherwise(F.array().cast(PLACES))


def with_labels(tokens: Column, base: Column) -> Column:
    """Tokens with `secret`: whether a base span overlaps them.

    Both lie in one sorted array: a token overlaps a span that starts before it and ends in it or
    later, or the next span after its start.
    """
    far = 2**31 - 1
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("token"), s["end"].alias("end"), F.lit("").alias("text"))),
            F.transform(tokens, lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("token"), m["end"].alias("end"), m["text"].alias("text"))),
        )
    )

    def marked(x: Column) -> Column:
        reach = running(F.transform(x, lambda y: F.when(y["token"] == 0, y["end"]).otherwise(0)), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(y["token"] == 0, y["start"]).otherwise(far))), F.least))
        near = F.zip_with(reach, after, lambda r, a: F.struct(r.alias("reach"), a.alias("after")))
        label = lambda y, n: F.struct(
            y["token"].alias("token"), y["start"].alias("start"), y["end"].alias("end"), y["text"].alias("text"),
            ((n["reach"] > y["start"]) | (n["after"] < y["end"])).alias("secret"),
        )
        only = F.filter(F.zip_with(x, near, label), lambda y: y["token"] == 1)
        return F.transform(only, lambda y: F.struct(*[y[c].alias(c) for c in ("start", "end", "text", "secret")]))

    return bind(both, marked)


def as_spans(places: Column, kind: int) -> Column:
    return F.transform(
        places, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )


def read_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The narrow table: (doc_id, text_hash, base spans, tokens with places and labels)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    # Runs shorter than the limit fail whole, so the limit can stand in the pattern of these two.
    access = f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}"
    df = df.select(
        "doc_id",
        F.xxhash64(t).alias("text_hash"),
        placed(t, ASSIGN).alias("assign"),
        F.when(t.rlike(ASSIGN), F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).alias("values"),
        placed(t, access).alias("access"),
        placed(t, f"[0-9a-f]{{{HEX_MIN},}}").alias("hex"),
        placed(t, TOKEN).alias("tokens"),
    )
    valued = F.zip_with("assign", "values", lambda m, v: F.when(F.length(v) >= ASSIGN_MIN, m))
    assign = F.coalesce(F.filter(valued, lambda m: m.isNotNull()), F.array().cast(PLACES))
    base = F.array_sort(F.concat(as_spans(assign, 0), as_spans(F.col("access"), 1), as_spans(F.col("hex"), 2)))
    df = df.select("doc_id", "text_hash", base.alias("base"), "tokens")
    return df.select("doc_id", "text_hash", "base", with_labels(F.col("tokens"), F.col("base")).alias("tokens"))


def characters(text: Column) -> Column:
    return F.split(text, "")


def train(texts: DataFrame) -> list[int]:
    """Log ratios of character pairs, random against ordinary, as a flat table in UNITs."""
    tokens = texts.select(F.explode("tokens").alias("t")).select(F.col("t.secret").alias("secret"), F.col("t.text").alias("text"))
    plain = ~F.col("text").rlike("[0-9]") | F.col("text").rlike("^[0-9]+$")
    tokens = tokens.where(F.col("secret") | plain)
    pairs = bind(
        characters(F.col("text")),
        lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)),
    )
    pair = F.explode(pairs)
    counted = tokens.select("secret", pair.alias("pair")).groupBy("secret", "pair").agg(F.count("*").alias("n"))
    counts = {(r["secret"], r["pair"]): r["n"] for r in counted.collect()}  # at most 2 x 66 x 66 rows
    size = len(ALPHABET)
    # How often each character follows any; what a first character has not shown yet backs off to it.
    follow = {k: {b: 1.0 + sum(counts.get((k, a + b), 0) for a in ALPHABET) for b in ALPHABET} for k in (True, False)}
    whole = {k: sum(follow[k].values()) for k in follow}
    ratios = []
    for a in ALPHABET:
        total = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in follow}
        for b in ALPHABET:
            chance = {
                k: (counts.get((k, a + b), 0) + BACK_OFF * follow[k][b] / whole[k]) / (total[k] + BACK_OFF) for k in follow
            }
            random = (chance[True] + 1 / size) / 2
            ratios.append(round(UNIT * math.log(random / chance[False])))
    return ratios


def score(token: Column, ratios: list[int]) -> Column:
    """Sum of the log ratios of a token's pairs."""
    table_ = F.from_json(F.lit(json.dumps(ratios)), "array<bigint>")
    letters = F.lit(ALPHABET)
    places = F.transform(characters(token), lambda c: F.instr(letters, c) - 1)
    pairs = bind(
        places,
        lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a * len(ALPHABET) + b + 1),
    )
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, p: s + F.element_at(table_, p))


def with_spans(texts: DataFrame, ratios: list[int]) -> DataFrame:
    """Add `spans`, base spans and random tokens outside them, in order."""
    def random(m: Column) -> Column:
        total = score(m["text"], ratios)
        return ~m["secret"] & (total >= F.greatest(F.lit(MIN_TOTAL), MIN_EACH * (F.length(m["text"]) - 1)))

    found = as_spans(F.filter("tokens", random), 3)
    return texts.withColumn("spans", F.array_sort(F.concat("base", found)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, base, tokens, spans), one a document."""
    texts = materialize(read_texts(docs, id_col, text_col), "secrets")
    return with_spans(texts, train(texts))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by MASK.

    Pieces between the spans are cut from the text, or from the array of its characters where there
    are many: finding a place in a text takes a pass over what is before it.
    """

    def cut(s: Column) -> Column:
        ends = running(F.transform(s["spans"], lambda x: x["end"]), F.greatest)

        def joined(reached: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), reached)
            # One more region than spans: the text behind the last of them.
            starts = F.concat(F.transform(s["spans"], lambda x: x["start"]), F.array(F.lit(2**31 - 1)))
            regions = F.filter(
                F.zip_with(before, starts, lambda a, b: F.struct(a.alias("from"), b.alias("to"))), lambda r: r["to"] >= r["from"]
            )
            by_text = F.transform(regions, lambda r: F.substr(s["text"], r["from"] + 1, r["to"] - r["from"]))
            by_array = bind(
                characters(s["text"]),
                lambda c: F.transform(regions, lambda r: F.array_join(F.slice(c, r["from"] + 1, r["to"] - r["from"]), "")),
            )
            return F.array_join(F.when(F.size(s["spans"]) <= FEW_SPANS, by_text).otherwise(by_array), MASK)

        return bind(ends, joined)

    return F.when(F.size(spans) == 0, text).otherwise(bind(F.struct(text.alias("text"), spans.alias("spans")), cut))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with all their columns, secrets masked in the text."""
    found = scan(docs, id_col, text_col).where(F.size("spans") > 0)
    names = [free_name(docs, c) for c in ("secret_id", "secret_hash", "secret_spans")]
    one = found.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "spans").toDF(*names)
    same = F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(text_col)) == F.col(names[1]))
    spans = F.coalesce(F.col(names[2]), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return docs.join(one, same, "left").withColumn(text_col, redact(F.col(text_col), spans)).select(*docs.columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _placed_sql(name: str, pattern: str, keep: str) -> str:
    """Matches with their places, from the matches and the pieces between them."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, m, i, coalesce(sum(gap + length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS s, length(m) AS size, v
  FROM (SELECT rid, i, hits[i] AS m, vals[i] AS v, length(gaps[i]) AS gap FROM (
    SELECT rid, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {2 if name == 'assign_all' else 0}) AS vals, string_split_regex(text, '{quoted}') AS gaps FROM texts)))
), {name}_kept AS (SELECT rid, CAST(s AS BIGINT) AS s, CAST(s + size AS BIGINT) AS e, m FROM {name} WHERE {keep})"""


def _op6_sql() -> str:
    anycase = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    keys = "|".join(anycase(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    size = len(ALPHABET)
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), {_placed_sql('assign_all', assign, f'length(v) >= {ASSIGN_MIN}')},
{_placed_sql('access_all', ACCESS, f'size >= {ACCESS_MIN}')},
{_placed_sql('hex_all', HEX, f'size >= {HEX_MIN}')},
{_placed_sql('token_all', TOKEN, 'true')},
base AS (
  SELECT rid, s, e, 0 AS k, 'assign' AS name FROM assign_all_kept UNION ALL SELECT rid, s, e, 1, 'access' FROM access_all_kept
  UNION ALL SELECT rid, s, e, 2, 'hex' FROM hex_all_kept
), tokens AS (
  SELECT t.rid, t.s, t.e, t.m, EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.s < t.e AND t.s < b.e) AS secret FROM token_all_kept t
), alphabet AS (
  SELECT substr('{ALPHABET}', CAST(i AS INT), 1) AS c FROM range(1, {size + 1}) r(i)
), pairs AS (
  SELECT secret, substr(m, CAST(i AS INT), 1) AS a, substr(m, CAST(i + 1 AS INT), 1) AS b FROM (
    SELECT secret, m, unnest(range(1, length(m))) AS i FROM tokens WHERE secret OR NOT regexp_matches(m, '[0-9]') OR regexp_matches(m, '^[0-9]+$'))
), grid AS (
  SELECT k.secret, x.c AS a, y.c AS b, count(p.a) AS n FROM (SELECT unnest([true, false]) AS secret) k CROSS JOIN alphabet x CROSS JOIN alphabet y
  LEFT JOIN pairs p ON p.secret = k.secret AND p.a = x.c AND p.b = y.c GROUP BY ALL
), follow AS (
  SELECT secret, b, 1.0::DOUBLE + sum(n) AS f FROM grid GROUP BY ALL
), chance AS (
  SELECT g.secret, g.a, g.b, (n + {BACK_OFF}::DOUBLE * f / sum(f) OVER (PARTITION BY g.secret, g.a)) / (sum(n) OVER (PARTITION BY g.secret, g.a) + {BACK_OFF}::DOUBLE) AS p
  FROM grid g JOIN follow USING (secret, b)
), ratios AS (
  SELECT r.a, r.b, CAST(round({UNIT} * ln((r.p + 1.0::DOUBLE / {size}) / 2 / o.p)) AS BIGINT) AS v FROM chance r JOIN chance o ON r.a = o.a AND r.b = o.b AND r.secret AND NOT o.secret
), scored AS (
  SELECT rid, s, e, length(any_value(m)) AS size, sum(v) AS total FROM (
    SELECT rid, s, e, m, substr(m, CAST(i AS INT), 1) AS a, substr(m, CAST(i + 1 AS INT), 1) AS b FROM (SELECT *, unnest(range(1, length(m))) AS i FROM tokens WHERE NOT secret)
  ) JOIN ratios USING (a, b) GROUP BY rid, s, e
), spans AS (
  SELECT * FROM base UNION ALL SELECT rid, s, e, 3, 'markov' FROM scored WHERE total >= greatest({MIN_TOTAL}, {MIN_EACH} * (size - 1))
), joined AS (
  SELECT rid, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k) AS all_spans, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base_spans,
         count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(all_spans, '') AS spans
FROM texts LEFT JOIN joined USING (rid)
"""


OP6_SQL = _op6_sql()
