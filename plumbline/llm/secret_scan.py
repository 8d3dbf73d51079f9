"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans.  A fourth kind comes from two
character Markov chains, one of random strings and one of ordinary identifiers,
both counted from labelled samples: a run of 16 or more token characters whose
log-likelihood ratio passes a threshold is a span of kind `markov`, unless it
overlaps a base span.

Positions are code points.  The engine's regex functions give no positions, so
they are summed up from the pieces between the matches: split and extract_all
walk a text alike, and the running sums are taken chunk by chunk, so a text of
many matches costs no square of their number.  Defined results: a null text is
empty and has no span; repeated rows and other columns pass through, but input
columns of the names `base` and `out` are replaced; spans of one kind don't
overlap, those of different kinds may.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

KINDS = ("assign", "access", "hex", "markov")
# The fixed patterns; the second group of the first is the value.  Maximal runs make the length limits of the others part of their pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
SPAN = "array<struct<start:int,kind:int,end:int>>"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET) + 1  # 0: before the first character, and any other sign

# Parts of ordinary identifiers: the labelled ordinary samples are joined from these.
WORDS = """account action active address admin agent alert archive array async author backup balance batch block buffer
build button cache calendar callback cancel catalog category channel check child class client cluster code collection
column command comment commit config connection container content context control cookie count create cursor custom
data database date debug default delete delta device dialog directory document domain driver dynamic element email
enable encoder entity entry error event exception export factory feature field file filter folder format frame function
gateway global group handler header height history image import index input instance integer interface internal invoice
item iterator kernel label language layer layout length level library limit listener local location manager mapping
matrix member memory message method metric model module monitor network notification number object offset operation
option order output package parameter parser partition password pattern payment percent permission platform player
pointer policy position preview primary process product profile project property provider query queue random record
reference region register remote render report request resource response result router sample schedule schema scope
screen search section segment selector sequence server service session setting shadow signal source stage state
station status storage stream string style subject summary switch system table target template thread timeout title
token total tracker traffic transaction transform trigger update upload usage user value vector version view visitor
volume warning weight widget window worker wrapper""".split()


def labelled_samples(spark: SparkSession, n: int = 6000, first: int = 0) -> DataFrame:
    """(token, random): `n` random strings and `n` ordinary identifiers, paths and numbers, all from rules; no two values of `first` more than `n` apart share one."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int") + 1
    w = [F.element_at(words, h(k)) for k in range(4)]
    digits = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10**12)).cast("string")
    ordinary = (
        F.when(F.col("id") % 8 == 0, F.concat_ws("_", *w[:3]))
        .when(F.col("id") % 8 == 1, F.concat(w[0], F.initcap(w[1]), F.initcap(w[2])))
        .when(F.col("id") % 8 == 2, F.concat_ws("-", *w[:3]))
        .when(F.col("id") % 8 == 3, F.concat(*w[:3]))
        .when(F.col("id") % 8 == 4, F.concat_ws("/", *w))
        .when(F.col("id") % 8 == 5, F.upper(F.concat_ws("_", *w[:3])))
        .when(F.col("id") % 8 == 6, F.concat(digits, F.reverse(digits)))
        .otherwise(F.concat_ws("-", w[0], F.date_format(F.date_add(F.lit("2000-01-01"), F.pmod(F.col("id"), F.lit(9000)).cast("int")), "yyyy-MM-dd"), F.substring(digits, 1, 6)))
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    random = (
        F.when(F.col("id") % 4 == 0, F.substring(b64, 1, 40))
        .when(F.col("id") % 4 == 1, F.regexp_replace(F.translate(b64, "+/", "-_"), "=", ""))
        .when(F.col("id") % 4 == 2, F.substring(digest, 1, 32))
        .otherwise(F.substring(F.upper(F.regexp_replace(b64, "[+/=]", "")), 1, 24))
    )
    ids = spark.range(first, first + n)
    return ids.select(ordinary.alias("token"), F.lit(False).alias("random")).unionByName(ids.select(random.alias("token"), F.lit(True).alias("random")))


def _codes() -> Column:
    place = {c: i + 1 for i, c in enumerate(ALPHABET)}
    return F.expr("array(" + ",".join(str(place.get(chr(k), 0)) for k in range(128)) + ")")


def _chars(token: Column) -> Column:
    """The token's characters as numbers of the alphabet."""
    codes = _codes()
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(codes, F.ascii(c)), F.lit(0)))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Log-likelihood ratios (random : ordinary) of all character pairs in thousandths of a nat; the table has a fixed size."""
    chars = samples.where("token is not null and random is not null").select("random", _chars(F.col("token")).alias("c"))
    pairs = chars.select("random", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.col("c")), F.col("c"), lambda a, b: a * WIDTH + b)).alias("pair"), F.size("c").alias("n"))
    counted = pairs.where("pair is not null").groupBy("random", "pair").count().collect()
    n = {True: [0.0] * WIDTH * WIDTH, False: [0.0] * WIDTH * WIDTH}
    for r in counted:
        if 0 <= r["pair"] < WIDTH * WIDTH:
            n[r["random"]][r["pair"]] += r["count"]
    out = []
    rows = {k: [sum(v[a * WIDTH : (a + 1) * WIDTH]) for a in range(WIDTH)] for k, v in n.items()}
    for pair in range(WIDTH * WIDTH):
        p, q = ((n[k][pair] + smoothing) / (rows[k][pair // WIDTH] + smoothing * WIDTH) for k in (True, False))
        out.append(round(1000 * math.log(p / q)))
    return out


def ratio(token: Column, model: list[int]) -> Column:
    """The token's log-likelihood ratio in thousandths of a nat."""
    table = F.expr("array(" + ",".join(map(str, model)) + ")")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(_chars(token), start, lambda s, c: F.struct(c.alias("at"), (s["sum"] + F.get(table, s["at"] * WIDTH + c)).alias("sum")), lambda s: s["sum"])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, combine, zero: int) -> Column:
    """For each number of an array all numbers before it, combined: chunks of a square root's length, then the chunks' totals."""
    start = F.array(F.lit(zero).cast("long"))
    running = lambda xs: F.aggregate(xs, start, lambda out, x: F.concat(out, F.array(combine(F.element_at(out, -1), x))))

    def whole(xs):
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / width).cast("int") - 1, F.lit(0))), lambda k: running(F.slice(xs, k * width + 1, width)))
        return let(chunks, joined)

    def joined(chunks):
        return let(running(F.transform(chunks, lambda c: F.element_at(c, -1))), lambda at: F.flatten(F.transform(chunks, lambda c, k: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: combine(F.get(at, k), x)))))

    return let(values, whole)


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans; keep(group's text) drops those that fail after they were matched."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    good = F.transform(F.regexp_extract_all(text, regex, F.lit(group)) if group else whole, keep if keep else lambda w: F.lit(True))
    matches = F.arrays_zip(F.slice(F.transform(F.split(text, pattern, -1), lambda b: F.length(b).cast("long")), 1, F.size(whole)).alias("b"), F.transform(whole, lambda w: F.length(w).cast("long")).alias("w"), good.alias("good"))

    def placed(ms):
        at = before(F.transform(ms, lambda m: m["b"] + m["w"]), lambda x, y: x + y, 0)
        spans = F.zip_with(ms, at, lambda m, a: F.struct((a + m["b"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (a + m["b"] + m["w"]).cast("int").alias("end"), m["good"].alias("good")))
        return F.transform(F.filter(spans, lambda x: x["good"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return F.when(text.rlike(pattern), let(matches, placed)).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, model: list[int], threshold: float = 8.0, text: str = "text", base: str = "base_spans", out: str = "all_spans") -> DataFrame:
    """`docs` with two arrays of spans (start, kind as index into KINDS, end), each sorted by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(_spans(t, ASSIGN, 0, lambda g: F.length(g) >= 6, 2), _spans(t, ACCESS, 1), _spans(t, HEX, 2))
    random = _spans(t, TOKEN, 3, lambda w: ratio(w, model) >= int(threshold * 1000))
    extra = free_name(docs, "random")
    staged = docs.withColumns({base: F.array_sort(found), extra: random})
    new = F.filter(extra, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return staged.withColumn(out, F.array_sort(F.concat(F.col(base), new))).drop(extra)


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, spans: str = "all_spans", text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """`docs` with every span of `text` replaced by `mark`, overlapping ones by one; texts without a span stay as they are."""
    t = F.col(text)

    def clean(both):
        # of fixed-width characters a piece is found without a walk from the text's start
        found, wide = both["spans"], both["wide"]
        piece = lambda a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")
        reached = before(F.transform(found, lambda x: x["end"].cast("long")), F.greatest, 0)  # the end of all spans before
        fresh = F.filter(F.zip_with(found, reached, lambda x, r: F.struct(x["start"].alias("start"), r.cast("int").alias("from"))), lambda x: x["start"] >= x["from"])
        pieces = F.transform(fresh, lambda x: piece(x["from"], x["start"]))
        rest = piece(F.array_max(F.transform(found, lambda x: x["end"])), (F.octet_length(wide) / 4).cast("int"))
        return F.concat(F.array_join(pieces, mark), F.lit(mark), rest)

    both = F.struct(F.col(spans).alias("spans"), F.encode(t, "UTF-32").alias("wide"))
    return docs.withColumn(text, F.when(F.size(F.col(spans)) > 0, let(both, clean)).otherwise(t))
