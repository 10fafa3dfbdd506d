"""Secret scan with DataFrame functions only: fixed patterns and Markov models.

Two character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples by counting character pairs. A
token is a secret if the log-likelihood ratio of the two models is high enough.
Pair probabilities are smoothed towards those of character classes, so that
letters that never met in the samples are not taken for random.

Spans are code point offsets, end exclusive. Matches are cut out with split() and
regexp_extract_all(), and their places are sums of the lengths before them, taken
in blocks of blocks, so finding very many matches in a text costs little more than
its length; redacting cuts parts of the text, not all of it, for each span.

Defined results: a null text has no spans, like an empty one; overlapping kinds
are all kept; spans of the models that touch a pattern's span are left out;
repeated rows stay; an empty table gives no rows. Extra columns are kept; columns
named _base and _spans are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, patterns and least lengths (of group 2 for assign).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_LENGTH = 8

#: Tokens that the models judge, and the characters that they know.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Least log-likelihood ratio of a secret, in nats, for the whole token and for a pair.
LEAST_TOTAL, LEAST_MEAN = 15.0, 0.5
#: Share of the class model in the mixture.
SMOOTHING = 0.2
#: Strings in each half of the built-in samples.
SAMPLES = 3000
PLACEHOLDER = "[secret]"

#: Values of a block in running folds, and characters of a part in which a text is cut.
_BLOCK, _CHUNK = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def labelled_samples(prose: DataFrame, text_column: str = "text") -> DataFrame:
    """(text, random): SAMPLES digests in four spellings, and identifiers made from words of a small prose table."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    spelled = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(F.substring(F.base64(F.unhex(digest)), 1, 40))).otherwise(F.base64(F.unhex(digest)))
    random = prose.sparkSession.range(SAMPLES).select(spelled.alias("text"), F.lit(True).alias("random"))
    words = F.filter(F.split(F.lower(F.col(text_column).cast("string")), "[^a-z]+"), lambda w: F.length(w) > 1)
    number = F.abs(F.hash("w", "next")) % 1000
    form = F.when(number % 4 == 0, F.concat_ws("_", "w", "next")).when(number % 4 == 1, F.concat("w", F.initcap("next"))).when(number % 4 == 2, F.upper(F.concat_ws("-", "w", "next"))).otherwise(F.concat("w", F.lit("/"), "next", number.cast("string")))
    pairs = prose.select(words.alias("words")).select("words", F.posexplode("words").alias("i", "w")).select("w", F.get("words", F.col("i") + 1).alias("next")).where("next is not null")
    ordinary = pairs.select(form.alias("text")).groupBy("text").count().orderBy(F.xxhash64("text"), "text").limit(SAMPLES).select("text", F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """The log ratio of every character pair, row by row of ALPHABET: a table of fixed size."""
    spark, n = samples.sparkSession, len(ALPHABET)
    classed = F.expr("case when i <= 26 then 1 when i <= 52 then 2 when i <= 62 then 3 else 4 end")
    chars = spark.range(1, n + 1).selectExpr("cast(id as int) i").withColumn("c", classed)
    sizes = chars.groupBy("c").agg(F.count("*").alias("size"))
    places = F.transform(F.split("text", ""), lambda x: F.instr(F.lit(ALPHABET), x))
    pairs = samples.select("random", places.alias("p")).where("size(p) > 1").select("random", F.expr("explode(transform(sequence(1, size(p) - 1), k -> struct(p[k - 1] a, p[k] b)))").alias("x"))
    counts = pairs.select("random", "x.a", "x.b").where("a > 0 and b > 0").groupBy("random", "a", "b").agg(F.count("*").alias("n"))
    a, b = chars.select(F.col("i").alias("a"), F.col("c").alias("ca")), chars.select(F.col("i").alias("b"), F.col("c").alias("cb"))
    grid = F.broadcast(spark.createDataFrame([(True,), (False,)], "random boolean")).crossJoin(a).crossJoin(b)
    full = grid.join(F.broadcast(counts), ["random", "a", "b"], "left").fillna(0, ["n"]).join(F.broadcast(sizes.select(F.col("c").alias("cb"), "size")), "cb")
    full = full.selectExpr("random", "a", "b", "n", "sum(n) over (partition by random, a) na", "size", "sum(n) over (partition by random, ca, cb) nc", "sum(n) over (partition by random, ca) nca")
    p = full.selectExpr("random", "a", "b", f"ln({1 - SMOOTHING} * n / (na + 1) + {SMOOTHING} * (nc + 1) / (nca + 4) / size) lp")
    ratio = p.groupBy("a", "b").agg(F.sum(F.when(F.col("random"), F.col("lp")).otherwise(-F.col("lp"))).alias("r"))
    return [row["r"] for row in ratio.orderBy("a", "b").collect()]


def _score(token: Column, model: Column) -> Column:
    """The log-likelihood ratio of a token."""
    n = len(ALPHABET)
    places = F.transform(F.split(token, ""), lambda x: F.instr(F.lit(ALPHABET), x))

    def total(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda acc, k: acc + F.element_at(model, (F.get(p, k - 1) - 1) * n + F.get(p, k)))

    return let(places, total)


def prefix(values: Column, fold: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """The running fold (a sum or a maximum of non-negative integers) of an array, in blocks of blocks.

    A place is folded from at most _BLOCK values and the running fold of whole
    blocks before it, so the work grows with the length of the array.
    """
    if levels == 0:
        return F.transform(values, lambda v, i: F.aggregate(F.slice(values, F.lit(1), i + 1), F.lit(0), fold))
    of = lambda part: F.aggregate(part, F.lit(0), fold)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: of(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    inside = lambda i: of(F.slice(values, i - i % _BLOCK + 1, i % _BLOCK + 1))
    whole = let(blocks, lambda x: prefix(x, fold, levels - 1))
    return let(whole, lambda x: F.transform(values, lambda v, i: fold(inside(i), F.coalesce(F.get(x, F.floor(i / _BLOCK).cast("int") - 1), F.lit(0)))))


def _places(text: Column, pattern: str, keep: Callable[[Column, Column], Column], kind: int, values: Callable[[Column], Column]) -> Column:
    """array<struct(start, kind, end)> of the leftmost non-overlapping matches that keep() holds for."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(x: Column) -> Column:
        gaps, found, kept = x["gaps"], x["found"], x["values"]
        lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def mark(e: Column) -> Column:
            every = F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), keep(m, F.get(kept, i)).alias("keep")))
            return F.transform(F.filter(every, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

        return let(let(lengths, lambda n: prefix(n, lambda a, b: a + b)), mark)

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("found"), values(whole).alias("values"))
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(empty)


def _apart(more: Column, base: Column) -> Column:
    """The spans of more that touch none of base, which is sorted; blocks of base that end before or begin after are passed over."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(base) - 1) / _BLOCK).cast("int")),
        lambda b: let(F.slice(base, b * _BLOCK + 1, F.lit(_BLOCK)), lambda own: F.struct(F.get(own, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(own, lambda t: t["end"])).alias("hi"), own.alias("own"))),
    )
    touches = lambda s, t: (t["start"] < s["end"]) & (s["start"] < t["end"])
    clear = lambda x: F.filter(more, lambda s: ~F.exists(x, lambda b: (b["lo"] < s["end"]) & (s["start"] < b["hi"]) & F.exists(b["own"], lambda t: touches(s, t))))
    return F.when((F.size(more) > 0) & (F.size(base) > 0), let(blocks, clear)).otherwise(more)


def scan(docs: DataFrame, model: list[float], text_column: str = "text") -> DataFrame:
    """The input with _base and _spans: array<struct(start, kind, end)>, sorted; kind indexes KINDS."""
    kept = [c for c in docs.columns if c.lower() not in ("_base", "_spans")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # one literal, which is folded
    whole = lambda *_: F.lit(True)
    base = F.concat(
        _places(text, ASSIGN, lambda m, v: F.length(v) >= ASSIGN_LENGTH, 0, lambda _: F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))),
        _places(text, ACCESS, whole, 1, lambda f: f),
        _places(text, HEX, whole, 2, lambda f: f),
    )
    random = lambda m, _: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & let(_score(m, table), lambda s: (s >= LEAST_TOTAL) & (s >= LEAST_MEAN * (F.length(m) - 1)))
    found = rows.select("row", F.array_sort(base).alias("_base"), _places(text, TOKEN, random, 3, lambda f: f).alias("more"))
    return found.select(*(F.col("row")[c].alias(c) for c in kept), "_base", F.array_sort(F.concat("_base", _apart(F.col("more"), F.col("_base")))).alias("_spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping or adjacent ones as one, replaced by the placeholder; spans are sorted."""

    def merged(reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(reach, i - 1)))
        return let(heads, lambda h: F.transform(h, lambda i, n: F.struct(F.get(spans, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, n + 1), F.size(spans)) - 1).alias("end"))))

    of = lambda n: F.floor(n / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), of(F.length(text))), lambda i: F.substr(text, i * _CHUNK + 1, F.lit(_CHUNK)))

    def piece(own: Column, a: Column, b: Column) -> Column:
        part = lambda i: let(F.greatest(a - i * _CHUNK, F.lit(0)), lambda lo: F.substr(F.get(own, i), lo + 1, F.least(b - i * _CHUNK, F.lit(_CHUNK)) - lo))
        return F.array_join(F.transform(F.sequence(of(a), of(b)), part), "")

    def rebuilt(m: Column) -> Column:
        joined = lambda own: F.transform(m, lambda s, i: F.concat(piece(own, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), s["start"]), F.lit(PLACEHOLDER)))
        return let(chunks, lambda own: F.concat(F.array_join(joined(own), ""), piece(own, F.element_at(m, -1)["end"], F.length(text))))

    reach = let(F.transform(spans, lambda s: s["end"]), lambda ends: prefix(ends, lambda a, b: F.greatest(a, b)))  # how far the spans up to this one go
    return F.when(F.size(spans) > 0, let(let(reach, merged), rebuilt)).otherwise(text)


def redacted(docs: DataFrame, model: list[float], text_column: str = "text") -> DataFrame:
    """The input with every secret in its text replaced by the placeholder; a null text stays null."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_column).cast("string").alias("text"))
    clean = redact(F.col("text"), F.col("_spans"))
    return scan(rows, model).select(*((clean if c == text_column else F.col("row")[c]).alias(c) for c in docs.columns))
