"""Secret scan: base patterns, and a randomness test battery.

Built-in column functions only.  Tested are tokens of at least 20 characters with
letters and digits: those that no base span touches, and the values of base spans
(of an assignment what is assigned, without padding), which stay whatever the
tests say.  A token is taken for the smallest encoding that holds it (hex,
base32, base36, base64).  Under the hypothesis of a uniform
random string four tests give p-values: chi-squared uniformity of the alphabet,
chi-squared of the character classes, runs above and below the middle symbol,
and lag-one serial correlation.  The least of the four is calibrated by SIMULATED
random tokens of the same encoding and about the same length, so that it is
uniform for random tokens however short.

False discoveries are controlled within each class of lengths, values of base
spans apart, over all different tokens of the corpus, copies counting once, on both sides.  Benjamini and Hochberg's procedure sets structured
tokens aside, so that of these the expected share of random ones is at most
ALPHA.  Of the others, reported as ``random``, the share of structured ones is
estimated from the counts of p-values above HALF, where random tokens are evenly
spread (Storey's estimate, one standard error granted), and the threshold is
raised until that share is at most ALPHA.

Defined results: a null text is empty; spans are in code points, end exclusive;
equal rows give equal rows; an empty table gives no rows; columns not named are
not read.  The time for a text grows with its matches to the power 1.5 at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The base patterns, kinds in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Stands for each character of a base span where tokens are looked for; a text's own ones are blanked.
COVER = "\ue000"
TOKEN = rf"(?<![A-Za-z0-9+/_{COVER}-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{20,}}+(?!{COVER})"
#: A value of a base span that is tested.
VALUE = "^(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}$"
#: Encoding: pattern of the whole token, alphabet, sizes of digits, lower case, upper case and the rest.
ENCODINGS = (
    ("^[0-9a-fA-F]+$", "0123456789abcdef", (10, 6, 0, 0)),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (6, 0, 26, 0)),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", (10, 26, 0, 0)),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (10, 26, 26, 2)),
)
NAMES = ("hex", "base32", "base36", "base64")
#: Least lengths of the classes within which discoveries are controlled.
LENGTHS = (20, 28, 40, 64)
#: Lengths at which random tokens are simulated; a token is held against the longest that is no longer.
GRID, SIMULATED = (20, 22, 24, 26, 28, 32, 36, 40, 48, 64, 96), 1000
TESTS = ("uniform", "classes", "runs", "serial")
ALPHA, HALF, BINS, PER_DECADE = 0.05, 0.5, 500, 50
#: Matches whose places are summed in one go.
RUN = 128


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, text, part) of the pattern's matches, ``part`` being a group of it.

    What ``split`` leaves between the matches gives their places, summed RUN
    matches at a time: one long fold would copy all it has at each match.
    """
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    zipped = F.arrays_zip(whole.alias("m"), part.alias("part"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,text:string,part:string>>")
    moved = lambda x: F.char_length(x["gap"]) + F.char_length(x["m"])

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + moved(x)
        item = F.struct((end - F.char_length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("text"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    def place(items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda n: F.slice(items, n * RUN + 1, RUN))
        return _bind(runs, lambda rs: _bind(F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + moved(x))), lambda sums: F.flatten(
            F.transform(rs, lambda r, n: F.aggregate(r, F.struct(F.aggregate(F.slice(sums, 1, n), F.lit(0), lambda a, x: a + x).alias("at"), none.alias("out")), step, lambda s: s["out"]))
        )))

    return F.when(text.rlike(pattern), _bind(zipped, place)).otherwise(none)


def _ranked(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def covered(text: Column) -> Column:
    """``text`` with COVER for each character of the assignments, the only base spans that are not part of one token."""
    plain = F.translate(text, COVER, " ")
    gaps, whole, value = F.split(plain, ASSIGN, -1), F.regexp_extract_all(plain, F.lit(ASSIGN), F.lit(0)), F.regexp_extract_all(plain, F.lit(ASSIGN), F.lit(2))
    hidden = F.zip_with(whole, value, lambda m, v: F.when(F.char_length(v) >= 6, F.repeat(F.lit(COVER), F.char_length(m))).otherwise(m))
    joined = F.array_join(F.zip_with(gaps, hidden, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(plain.rlike(ASSIGN), joined).otherwise(plain)


def found_in(text: Column) -> tuple[Column, Column]:
    """Base spans (start, rank, end, kind), and the tokens to be tested (start, rank, end, text)."""
    assign = F.filter(spans(text, ASSIGN, 2), lambda s: F.char_length(s["part"]) >= 6)
    access = F.filter(spans(text, ACCESS), lambda s: s["end"] - s["start"] >= 20)
    long = spans(text, HEX)
    base = F.array_sort(F.concat(_ranked(assign, "assign"), _ranked(access, "access"), _ranked(long, "hex")))
    apart = F.filter(spans(covered(text), TOKEN), lambda s: ~s["text"].rlike(ACCESS_LONG) & ~s["text"].rlike(HEX))

    def item(kind: str, value) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), value(s).alias("text"))

    whole = lambda s: s["text"]
    given = F.concat(F.transform(assign, item("assign", lambda s: F.rtrim(s["part"], F.lit("=")))), F.transform(access, item("access", whole)), F.transform(long, item("hex", whole)))
    return base, F.concat(F.filter(given, lambda s: s["text"].rlike(VALUE)), F.transform(apart, item("random", whole)))


# ---- tests of a token, given as numbers of its symbols --------------------------------------


def _two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)), by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(poly * F.exp(-x * x), F.lit(1.0))


def _upper_chi(value: Column, freedom: Column) -> Column:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    spread = 2 / (9 * freedom)
    z = (F.cbrt(value / freedom) - (1 - spread)) / F.sqrt(spread)
    half = _two_sided(z) / 2
    return F.when(z > 0, half).otherwise(1 - half)


def _of(encoding: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), encoding + 1)


def p_value(token: Column, encoding: Column) -> Column:
    """The least p-value of the battery for a token of an encoding (its number in ENCODINGS)."""
    alphabet, k, n = _of(encoding, [a for _, a, _ in ENCODINGS]), _of(encoding, [float(len(a)) for _, a, _ in ENCODINGS]), F.char_length(token).cast("double")
    shown = F.when(encoding == 0, F.lower(token)).when(encoding == len(ENCODINGS) - 1, F.translate(token, "-_", "+/")).otherwise(token)
    mixed = F.lit(0.0)
    for j, symbols in enumerate(("0-9", "a-z", "A-Z", "+/")):
        due = n * _of(encoding, [float(sizes[j]) for *_, sizes in ENCODINGS]) / k
        mixed = mixed + F.when(due > 0, F.pow(F.char_length(F.regexp_replace(shown, f"[^{symbols}]", "")) - due, F.lit(2.0)) / due).otherwise(0.0)
    freedom = _of(encoding, [float(sum(x > 0 for x in sizes) - 1) for *_, sizes in ENCODINGS])
    pairs = lambda xs: F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    add = lambda xs, f, first=0.0: F.aggregate(xs, F.lit(first), lambda a, x: a + f(x))

    def least(x: Column) -> Column:
        """From squares of the symbols' counts, symbols of the upper half, runs, and lagged products."""
        both = 2 * x["ones"] * (n - x["ones"])
        mean, var = both / n + 1, both * (both - n) / (n * n * (n - 1))
        runs = F.when(var > 0, _two_sided((x["turns"] - mean) / F.sqrt(var))).otherwise(0.0)
        serial = _two_sided(x["lagged"] / ((x["k"] * x["k"] - 1) / 12 * F.sqrt(n - 1)))
        return F.least(_upper_chi(x["squares"] * x["k"] / n - n, x["k"] - 1), _upper_chi(x["mixed"], x["freedom"]), runs, serial)

    def sums(x: Column) -> Column:
        values, high = x["values"], x["high"]
        shown = x["shown"]
        squares = add(F.array_distinct(F.split(shown, "")), lambda c: F.pow(F.char_length(shown) - F.char_length(F.replace(shown, c, F.lit(""))), F.lit(2.0)))
        lagged = add(pairs(values), lambda y: (y["a"] - (x["k"] - 1) / 2) * (y["b"] - (x["k"] - 1) / 2))
        return F.struct(
            squares.alias("squares"), add(high, lambda v: v).alias("ones"), add(pairs(high), lambda y: F.abs(y["a"] - y["b"]), 1.0).alias("turns"), lagged.alias("lagged"), x["k"].alias("k"), x["mixed"].alias("mixed"), x["freedom"].alias("freedom")
        )

    def halves(x: Column) -> Column:
        return F.struct(x["shown"].alias("shown"), x["values"].alias("values"), F.transform(x["values"], lambda v: (v >= x["k"] / 2).cast("double")).alias("high"), x["k"].alias("k"), x["mixed"].alias("mixed"), x["freedom"].alias("freedom"))

    given = _bind(F.struct(alphabet.alias("alphabet"), shown.alias("shown")), lambda x: F.transform(F.split(x["shown"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 1))
    start = F.struct(shown.alias("shown"), given.alias("values"), k.alias("k"), mixed.alias("mixed"), freedom.alias("freedom"))
    return _bind(_bind(_bind(start, halves), sums), least)


def _encoding(token: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for n, (pattern, *_) in reversed(list(enumerate(ENCODINGS[:-1]))):
        out = F.when(token.rlike(pattern), F.lit(n)).otherwise(out)
    return out


def _steps(value: Column, least: tuple[int, ...]) -> Column:
    """The place of the last of ``least`` that ``value`` reaches; the first, if none."""
    out = F.lit(0)
    for n, x in enumerate(least[1:], 1):
        out = F.when(value >= x, F.lit(n)).otherwise(out)
    return out


def tested(tokens: DataFrame) -> DataFrame:
    """``tokens`` (with ``text``, and ``encoding`` of it) with length class, grid place and bin of the battery's least p-value."""
    p = p_value(F.col("text"), F.col("encoding"))
    length = F.char_length("text")
    named = tokens.withColumns({"class": _steps(length, LENGTHS), "grid": _steps(length, GRID), "p": F.greatest(p, F.lit(1e-300))})
    return named.withColumn("bin", F.least(F.lit(BINS), F.floor(-F.log10("p") * PER_DECADE)).cast("int")).drop("p", "text")


_tables: dict[str, list[tuple]] = {}


def simulated(spark: SparkSession) -> DataFrame:
    """Random tokens that the scan would test, of each encoding and grid length: encoding, text."""
    cell, pick = F.floor(F.col("id") / SIMULATED), lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    frame = spark.range(SIMULATED * len(ENCODINGS) * len(GRID), numPartitions=8)
    frame = frame.select("id", (cell % len(ENCODINGS)).cast("int").alias("encoding"), pick(GRID, F.floor(cell / len(ENCODINGS))).alias("length"))
    frame = frame.withColumn("alphabet", pick([x for _, x, _ in ENCODINGS], F.col("encoding")))
    symbol = lambda n: F.substring("alphabet", (F.pmod(F.xxhash64(F.lit("simulated"), "id", n), F.char_length("alphabet")) + 1).cast("int"), F.lit(1))
    frame = frame.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.col("length")), symbol), ""))
    return frame.where(F.col("text").rlike("[0-9]") & F.col("text").rlike("[A-Za-z]")).select("encoding", "text")


def calibration(spark: SparkSession) -> DataFrame:
    """encoding, grid, bin and the calibrated p-value, for every bin: the share of simulated random tokens at or beyond it.

    Beyond all of them, the tests' own p-value times their number.  Simulated
    once in an application; a row for each encoding, grid length and bin.
    """
    key = spark.sparkContext.applicationId
    if key not in _tables:
        _tables[key] = [tuple(r) for r in tested(common.materialise(simulated(spark), "simulated")).groupBy("encoding", "grid", "bin").agg(F.count("*").alias("n")).collect()]
    made = spark.createDataFrame(_tables[key], "encoding int, grid int, bin int, n long")
    every = made.groupBy("encoding", "grid").agg(F.sum("n").alias("all")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS))))
    beyond = Window.partitionBy("encoding", "grid").orderBy(F.col("bin").desc())
    counted = every.join(made, ["encoding", "grid", "bin"], "left").withColumn("beyond", F.sum(F.coalesce("n", F.lit(0))).over(beyond))
    tail = F.least(1 / (F.col("all") + 1), len(TESTS) * F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE))
    return counted.select("encoding", "grid", "bin", F.when(F.col("beyond") > 0, (F.col("beyond") + 1) / (F.col("all") + 1)).otherwise(tail).alias("p"))


def thresholds(each: DataFrame) -> DataFrame:
    """class and limit: tokens with a p-value above the limit are reported.  ``each`` counts tokens (n) by class and p."""
    whole, upto = Window.partitionBy("class"), Window.partitionBy("class").orderBy("p")
    counted = each.withColumns({"rank": F.sum("n").over(upto), "all": F.sum("n").over(whole), "high": F.sum(F.when(F.col("p") > HALF, F.col("n")).otherwise(0)).over(whole)})
    aside = F.max(F.when(F.col("p") <= ALPHA * F.col("rank") / F.col("all"), F.col("p"))).over(whole)
    random = F.least(F.col("all").cast("double"), (F.col("high") + F.sqrt("high") + 1) / (1 - HALF))
    counted = counted.withColumns({"aside": F.coalesce(aside, F.lit(0.0)), "random": random})
    # Of the tokens above each p-value, those above what random ones amount to.
    left = F.col("all") - F.col("rank")
    good = left - F.col("random") * (1 - F.col("p")) <= ALPHA * left
    start = counted.groupBy("class").agg(F.first("aside").alias("aside"), F.first("all").alias("all"), F.first("random").alias("random"))
    start = start.select("class", "aside", F.when((F.col("aside") == 0) & (F.col("all") - F.col("random") <= ALPHA * F.col("all")), F.lit(0.0)).alias("none"))
    first = counted.where(good & (F.col("p") >= F.col("aside"))).groupBy("class").agg(F.min("p").alias("first"))
    return start.join(first, "class", "left").select("class", F.coalesce("none", "first", F.lit(1.0)).alias("limit"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base (spans), found (spans of random tokens) and tests (of base spans too) of every row; one pass over the texts.

    A test holds start, rank, end, kind, encoding, the calibrated p-value and whether the token counts as random.
    """
    base, tokens = found_in(F.col("t"))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    rows = common.numbered(texts.select("doc_id", base.alias("base"), tokens.alias("tokens")), "tokens", "number")
    single = rows.select("number", F.explode("tokens").alias("x")).select("number", "x.start", "x.rank", "x.end", "x.text").withColumns({"encoding": _encoding(F.col("text")), "token": F.xxhash64("text")})
    pool = F.col("class") + F.when(F.col("rank") < KINDS.index("random"), len(LENGTHS)).otherwise(0)
    seen = common.materialise(tested(single).join(F.broadcast(calibration(docs.sparkSession)), ["encoding", "grid", "bin"]).select("number", "start", "rank", "end", "encoding", pool.alias("class"), "p", "token"), "tested")
    once = seen.groupBy("class", "p", "token").agg(F.lit(1))
    limits = thresholds(once.groupBy("class", "p").agg(F.count("*").alias("n")))  # a row for each class
    judged = seen.join(F.broadcast(limits), "class").withColumn("random", F.col("p") > F.col("limit"))
    item = F.struct("start", "rank", "end", _of(F.col("rank"), list(KINDS)).alias("kind"), _of(F.col("encoding"), list(NAMES)).alias("encoding"), "p", "random")
    tests = judged.groupBy("number").agg(F.sort_array(F.collect_list(item)).alias("tests"))  # as many as its text has
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,encoding:string,p:double,random:boolean>>")
    told = rows.join(tests, "number", "left").select("doc_id", "base", F.coalesce("tests", none).alias("tests"))
    new = F.filter("tests", lambda s: s["random"] & (s["rank"] == KINDS.index("random")))
    return told.select("doc_id", "base", F.transform(new, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("found"), "tests")


def join_spans(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def join_tests(column: Column) -> Column:
    """kind:start:end:encoding:p:verdict of each test, comma-joined; p to four places."""
    verdict = lambda s: F.when(s["random"], "random").otherwise("structured")
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["encoding"], F.format_number(s["p"], 4), verdict(s))
    return F.array_join(F.transform(column, shown), ",")


def digest(found: DataFrame) -> DataFrame:
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in KINDS[:3]), F.sha2(join_spans(F.col("base")), 256).alias("base_sha256"), join_spans(F.array_sort(F.concat("base", "found"))).alias("spans"), join_tests(F.col("tests")).alias("tests"))
