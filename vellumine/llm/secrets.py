"""Secret scans: fixed patterns, and a randomness test battery over encoded tokens with false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import small, table

_KEY = r"(?i:password|passwd|secret|token|api_?key)"
#: kind -> pattern, group that counts, least length of it. A span is the whole match.
BASE = {
    "assign": (_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # what + takes and 32 drops is the same: maximal runs
}
#: "=" only pads: what follows one is a token of its own.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: encoding -> (pattern, size of its alphabet, index of coincidence of unrandom strings written in it), the narrowest first.
ENCODINGS = {
    "decimal": (r"^[0-9]+$", 10, 0.16),
    "hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.12),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", 32, 0.075),
    "base36": (r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-z]+|[0-9A-Z]+)$", 36, 0.07),
    "base62": (r"^(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$", 62, 0.06),
    "base64": (r"^(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/_-]+=*$", 64, 0.06),
}
#: Rate of false discoveries; level at which runs and serial correlation speak against randomness; bins a power of two.
FDR, LEVEL, BINS = 0.01, 0.001, 4


def phi(z: Column) -> Column:
    """The normal distribution function by a rational approximation (error under 1e-7); of the far tail, its leading term."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.when(x > 6, F.exp(-x * x / 2) / (x * math.sqrt(2 * math.pi))).otherwise(F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly)
    return F.when(z < 0, tail).otherwise(1.0 - tail)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(sizes: Column, n: Column) -> Column:
    """Running sums of the n values of array<int> by doubling: log2(n) passes over the whole array.

    aggregate() copies what it has gathered at each step, so an array that grows by a value a step would take quadratic time.
    """
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int"), F.lit(1)) - 1)
    shifted = lambda a, k: F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2.0), k).cast("int")), a), 1, F.size(a))
    return F.aggregate(passes, sizes, lambda a, k: F.zip_with(a, shifted(a, k), lambda x, y: x + y))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches: gaps between matches and the matches tile the text."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(m: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda gap, x: F.length(gap) + F.length(x))
        spans = F.zip_with(_sums(sizes, F.size(m)), m, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value")))
        return F.zip_with(spans, value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value"))) if group else spans

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, kind, end>> of the fixed patterns, sorted by start, then kind as listed."""
    def spans(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(_matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    kinds = [spans(rank, kind, *how) for rank, (kind, how) in enumerate(BASE.items())]
    return F.array_sort(F.concat(*kinds))


def _encoding(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(ENCODINGS.items()):
        out = F.when(F.rlike(v, F.lit(pattern)), name).otherwise(out)
    return out


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """tokens with encoding, n, p, p_runs and p_serial of each; encoding is null where none is inferred, and then the others tell nothing.

    p is how likely an unrandom string of the encoding and length is to be as even as the token: the chi-squared statistic
    against an even alphabet, which for such strings is noncentral in proportion to length (normal approximation).
    p_runs: of Wald and Wolfowitz' runs above and below the middle of the alphabet as sorted in the token; p_serial: of the
    correlation of each character's code with the next; both two-sided, and of a random string evenly spread.
    Each step is a projection of its own, so that no figure is worked out twice.
    """
    names, v = tokens.columns, F.col(token)
    d = tokens.withColumns({"encoding": _encoding(v), "__body": F.regexp_replace(v, "=+$", "")})
    d = d.withColumn("__codes", F.transform(F.filter(F.split("__body", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double")))
    d = d.withColumns({"__sorted": F.array_sort("__codes"), "n": F.size("__codes"), "__mean": F.aggregate("__codes", F.lit(0.0), lambda a, x: a + x) / F.size("__codes")})
    d = d.withColumn("__middle", F.get("__sorted", F.floor(F.col("n") / 2).cast("int")))
    run = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))  # squares: of each character's number; (k + 1)^2 is k^2 + 2k + 1

    def count(a: Column, x: Column) -> Column:
        again = F.when(x == a["last"], a["run"]).otherwise(0.0)
        return F.struct(x.alias("last"), (again + 1.0).alias("run"), (a["squares"] + 2.0 * again + 1.0).alias("squares"))

    walk = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial"), F.lit(0.0).alias("high"), F.lit(0.0).alias("var"))
    mean, middle = F.col("__mean"), F.col("__middle")

    def step(a: Column, x: Column) -> Column:
        changed = F.coalesce(((x >= middle) != (a["last"] >= middle)).cast("double"), F.lit(0.0))
        serial = F.coalesce((a["last"] - mean) * (x - mean), F.lit(0.0))
        return F.struct(x.alias("last"), (a["runs"] + changed).alias("runs"), (a["serial"] + serial).alias("serial"), (a["high"] + (x >= middle).cast("double")).alias("high"), (a["var"] + (x - mean) * (x - mean)).alias("var"))

    d = d.withColumns({"__squares": F.aggregate("__sorted", run, count)["squares"], "__w": F.aggregate("__codes", walk, step)})
    size, skew = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (_, a, ic) in ENCODINGS.items():
        size, skew = F.when(F.col("encoding") == name, float(a)).otherwise(size), F.when(F.col("encoding") == name, a * ic - 1).otherwise(skew)
    d = d.withColumns({"__n": F.col("n").cast("double"), "__size": size, "__skew": skew})
    n, n1, var, df, skew = F.col("__n"), F.col("__w.high"), F.col("__w.var"), F.col("__size") - 1, F.col("__skew")
    mu = 2 * n1 * (n - n1) / n + 1
    d = d.withColumns({"__chi": (F.col("__size") / n * F.col("__squares") - n - (df + n * skew)) / F.sqrt(2 * (df + 2 * n * skew)), "__spread": (mu - 1) * (mu - 2) / (n - 1)})
    d = d.withColumns({
        "__zr": F.when(F.col("__spread") > 0, -F.abs((F.col("__w.runs") - mu) / F.sqrt("__spread"))),
        "__zs": F.when(var > 0, -F.abs((F.col("__w.serial") / var + 1 / n) * F.sqrt(n))),
    })
    return d.select(
        *names, "encoding", "n", F.when(F.col("encoding").isNotNull(), phi(F.col("__chi"))).alias("p"),
        F.coalesce(2 * phi(F.col("__zr")), F.lit(0.0)).alias("p_runs"), F.coalesce(2 * phi(F.col("__zs")), F.lit(0.0)).alias("p_serial"),
    )


def _bin(p: Column) -> Column:
    """Whole steps of 1/BINS powers of two under 1, so that p is at most 2^(-bin / BINS)."""
    return F.least(F.lit(400), F.floor(-F.log2(F.greatest(p, F.lit(1e-40))) * BINS)).cast("int")


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Length class -> least bin accepted, by Benjamini and Hochberg's step-up inside each class, over (n, p) of all tokens.

    p-values are rounded up to their bin's edge, so the rate holds. At most 32 classes of 401 bins reach the driver.
    """
    counts = tested.groupBy(_length_class(F.col("n")).alias("c"), _bin(F.col("p")).alias("b")).count().collect()
    out: dict[int, int] = {}
    for c in {r.c for r in counts}:
        total, above = sum(r["count"] for r in counts if r.c == c), 0
        for b, k in sorted(((r.b, r["count"]) for r in counts if r.c == c), reverse=True):
            above += k
            if 2.0 ** (-b / BINS) <= fdr * above / total:
                out[c] = b
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """docs' id with base (array of fixed spans) and random (array of tested spans with their figures) for each row.

    Spans are in code points, the end exclusive. A token of twenty or more characters is a random span if its p is under
    its length class's threshold and neither runs nor serial correlation speak against randomness. Texts are read once: fixed
    spans and tokens are written, the tokens are tested as rows, and those that pass return to their rows by id and the text's hash.
    Null and empty texts have no spans. Rows that repeat an id and rows of a null id are scanned as any other; no rows give no
    rows; other columns play no part. The work grows about in proportion to a text's matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    seen = table(d.select("id", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"), _matches(F.col("text"), TOKEN, 0).alias("tokens")), "tokens")
    rows = seen.where(F.size("tokens") > 0).select("id", "h", F.explode("tokens").alias("t")).select("id", "h", "t.start", "t.end", F.col("t.value").alias("token"))
    # written, as it is read twice and a filter on figures that is pushed below all their steps would write them out again and again
    tested = table(battery(rows).where("encoding is not null").drop("token"), "tested")
    found = thresholds(tested.select("n", "p"), fdr)
    limits = F.create_map(*[F.lit(x) for kv in found.items() for x in kv]) if found else F.create_map().cast("map<int,int>")
    passed = tested.where((_bin(F.col("p")) >= F.coalesce(limits[_length_class(F.col("n"))], F.lit(10_000))) & (F.col("p_runs") >= LEVEL) & (F.col("p_serial") >= LEVEL))
    figures = F.struct("start", "end", F.struct("encoding", "n", "p", "p_runs", "p_serial").alias("s"))
    per = passed.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.array_sort(F.collect_set(figures)).alias("random"))  # a text's own tokens; equal rows' are the same
    out = seen.join(small(per), (F.col("h") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    none = F.array().cast("array<struct<start:int,end:int,s:struct<encoding:string,n:int,p:double,p_runs:double,p_serial:double>>>")
    return out.select("id", "base", F.coalesce("random", none).alias("random"))


def report(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of scan()'s rows."""
    base = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    rank = len(BASE)
    extra = F.transform("random", lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit("random").alias("kind"), m["end"].alias("end")))
    spans = F.transform(F.array_sort(F.concat("base", extra)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        F.col("id").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
