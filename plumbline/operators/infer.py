"""What a schema leaves unsaid: undeclared keys, copied columns, cryptic names, quantities.

The rules run as joins over the catalog's columns and names held as
DataFrames, so a catalog of many tables is no different from a small one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import find_table, name_quality, table_variants
from ..functions.types import column_xsd
from ..sources import scratch
from ..sources.catalog import TableMeta

#: What may follow a table's name in a column that refers to it, and words of copied texts.
KEY_TAILS = ("id", "_id", "sk", "_sk", "")
TEXT_WORDS = ("name", "title", "description", "desc", "label")
#: Forms of a referring column, tried in this order; group 1 is the table's name.
FORMS = (("suffix_id", "^(.+?)_?id$"), ("prefix_id", "^id_?(.+)$"), ("prefix_fk", "^fk_?(.+)$"), ("suffix_fk", "^(.+?)_?fk$"), ("suffix_sk", "^(.+?)_?sk$"), ("tpcds_sk", "^[a-z]{1,3}_(.+?)_?sk$"))


@dataclass(frozen=True)
class InferredLink:
    table: str
    column: str
    target: str
    target_column: str
    pattern: str
    confidence: str


def link_confidence(column: str, column_type: str, word: str, target_name: str, target_type: str | None) -> str:
    """How sure a link is: types that agree, the word found in the column against the table's name, and the column's ending."""
    score = 0
    if target_type is not None:
        a, b = column_type.lower(), target_type.lower()
        score += 2 * (a == b or ("int" in a and "int" in b))
    word, name = word.lower(), target_name.lower()
    score += 2 if word == name else 1 if f"{word}s" == name else 0
    score += column.lower().endswith("id")
    return "high" if score >= 4 else "medium" if score >= 2 else "low"


def implicit_links(tables: list[TableMeta], key_suffix: bool = False) -> list[InferredLink]:
    """Undeclared references of columns to tables, at most one each.

    First a table's name embedded in the column's, longest names first, then
    the forms.  ``key_suffix`` also takes ``<table>key`` columns.
    """
    names = [t.name for t in tables]
    by, variants = {t.name: t for t in tables}, table_variants(names)
    tails = (*KEY_TAILS, "key", "_key") if key_suffix else KEY_TAILS
    out = []
    for t in tables:
        declared = {k.column.lower() for k in t.foreign_keys}
        for c in t.columns:
            if c.is_primary_key or c.name.lower() in declared:
                continue
            hit = _embedded(c.name.lower(), t.name, variants, tails) or _formed(c.name.lower(), t.name, names)
            if hit:
                target, pattern, word = hit
                meta = by[target]
                key = meta.primary_keys[0] if meta.primary_keys else "id"
                kind = meta.column(key).data_type if meta.primary_keys and meta.column(key) else None
                out.append(InferredLink(t.name, c.name, target, key, pattern, link_confidence(c.name, c.data_type, word, target, kind)))
    return out


def _embedded(column: str, own: str, variants: dict[str, str], tails: tuple[str, ...]) -> tuple[str, str, str] | None:
    for word, table in variants.items():
        if len(word) >= 4 and table != own and word in column and column.split(word, 1)[1] in tails:
            return table, "embedded_table_name", word
    return None


def _formed(column: str, own: str, names: list[str]) -> tuple[str, str, str] | None:
    for pattern, form in FORMS:
        m = re.match(form, column)
        if m and len(m[1]) >= 3 and (table := find_table(m[1], names)) and table != own:
            return table, pattern, m[1]
    return None


def copied_columns(tables: list[TableMeta]) -> list[dict]:
    """Text columns that seem to repeat another table's text."""
    variants, out = table_variants([t.name for t in tables]), []
    for t in tables:
        for c in t.columns:
            column = c.name.lower()
            if not any(x in c.data_type.lower() for x in ("char", "text", "string")):
                continue
            for word, table in variants.items():
                if len(word) < 4 or table == t.name or word not in column:
                    continue
                tail = column.split(word, 1)[1]
                if column == word or any(w in column for w in TEXT_WORDS) or tail in ("", "name", "title", "desc", "description"):
                    out.append({"table": t.name, "column": c.name, "likely_source": table})
                    break
    return out


def cryptic_names(tables: list[TableMeta]) -> dict:
    """Tables and columns whose names want a better one, and how many of how many."""
    found = {"tables": [], "columns": []}
    for t in tables:
        if (q := name_quality(t.name)).is_cryptic:
            found["tables"].append({"name": t.name, "reasons": list(q.reasons), "confidence": q.confidence})
        for c in t.columns:
            if (q := name_quality(c.name)).is_cryptic:
                found["columns"].append({"table": t.name, "name": c.name, "data_type": c.data_type, "reasons": list(q.reasons), "confidence": q.confidence})
    total = len(tables) + sum(len(t.columns) for t in tables)
    return found | {"summary": {"total_names": total, "cryptic_names": len(found["tables"]) + len(found["columns"])}}


def type_overrides(tables: list[TableMeta], by_word: bool = False) -> list[dict]:
    made = (column_xsd(c.data_type, c.name, t.name, by_word)[1] for t in tables for c in t.columns)
    return [vars(x) for x in made if x]


def quality_report(tables: list[TableMeta], key_suffix: bool = False) -> dict:
    links, copies, overrides = implicit_links(tables, key_suffix), copied_columns(tables), type_overrides(tables)
    return {
        "inferred_relationships": [vars(x) for x in links],
        "denormalized_fields": copies,
        "type_overrides": overrides,
        "summary": {"inferred_relationships": len(links), "denormalized_fields": len(copies), "type_overrides": len(overrides), "high_confidence": sum(x.confidence == "high" for x in links)},
    }


# ---- over a catalog held as a DataFrame -----------------------------------------------------
#
# ``columns`` has a row for each column: table_name, column_name, position, data_type,
# is_primary_key, is_foreign_key.  Tables count in the order of their names.

#: Rows of a table's names, words or keys that may go to every task; of more, Spark decides.
FEW = 100_000
#: Length of the grams by which words are looked up in column names, that of the shortest word.
GRAM = 4


def _singular(word: str) -> Column:
    """Of a column of lower-case names, as ``naming.singular``."""
    w = F.col(word)
    cut = lambda ending, instead: F.when(w.endswith(ending) & (F.length(w) > len(ending)), F.concat(F.expr(f"substring({word}, 1, length({word}) - {len(ending)})"), F.lit(instead)))
    return F.coalesce(cut("ies", "y"), cut("es", ""), cut("s", ""))


def words_df(columns: DataFrame) -> DataFrame:
    """word, target, turn: names and singulars of tables; of equal words the last table's, ``turn`` being the first's place."""
    names = columns.select("table_name").distinct().withColumn("lower", F.lower("table_name"))
    forms = names.select("table_name", F.posexplode(F.array("lower", _singular("lower"))).alias("kind", "word")).where(F.length("word") >= GRAM)
    last, first = F.struct("table_name", "kind"), F.min(F.struct("table_name", "kind"))
    return forms.groupBy("word").agg(F.max(last)["table_name"].alias("target"), first.alias("turn"))


def _few(made: DataFrame, tag: str) -> DataFrame:
    """``made``, written to the shared folder, sent to every task if it has few rows.

    What is joined with it, a row for each gram or form of each name, then stays where it is.
    """
    path = scratch.folder(made.sparkSession, tag)
    made.write.parquet(path)
    made = made.sparkSession.read.schema(made.schema).parquet(path)
    return F.broadcast(made) if made.count() <= FEW else made


def _grams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda n: F.struct(n.alias("at"), F.substr(text, n, F.lit(GRAM)).alias("gram")))


def _name_words(names: DataFrame, columns: DataFrame) -> DataFrame:
    """``names`` (c) with each word that c holds: word, target, turn, and the tail after its first place.

    An inverted index on grams: a word is filed under the rarest of its grams,
    so that beginnings which many names share bring no columns and words together.
    """
    words = words_df(columns)
    filed = words.select("*", F.explode(_grams(F.col("word"))).alias("g")).select("*", "g.gram", "g.at")
    common = filed.groupBy("gram").agg(F.count("*").alias("words"))
    rarest = F.min(F.struct("words", "at", "gram", "target", "turn")).alias("x")
    index = filed.join(common, "gram").groupBy("word").agg(rarest).select("word", "x.gram", F.col("x.at").alias("offset"), "x.target", "x.turn")
    held = names.where(F.length("c") >= GRAM).select("*", F.explode(_grams(F.col("c"))).alias("g")).select("*", "g.gram", (F.col("g.at")).alias("at")).drop("g")
    start = F.col("at") - F.col("offset") + 1
    met = held.join(_few(index, "index"), "gram").where(start > 0).where(F.instr(F.col("c"), F.col("word")) == start)
    return met.withColumn("tail", F.expr("substring(c, at - offset + 1 + length(word))")).drop("gram", "at", "offset")


def found_words(free: DataFrame, columns: DataFrame) -> DataFrame:
    """``free`` (table_name, column_name, c and more) with each word of another table that c holds: word, target, turn, and the tail after its first place.

    Each different name is looked up once, however many tables have such a column.
    """
    return free.join(_name_words(free.select("c").distinct(), columns), "c").where(F.col("target") != F.col("table_name"))


#: A candidate of a name, in the order of preference: rule, place in it, turn, target; then what tells how it was found.
_CANDIDATE = ("rule", "place", "turn", "target", "word", "pattern")


def _embedded_names(names: DataFrame, columns: DataFrame, tails: tuple[str, ...]) -> DataFrame:
    """Of the words that are followed by nothing but a tail the longest come first, then those whose table comes first."""
    hits = _name_words(names, columns).where(F.col("tail").isin(*tails))
    return hits.select("c", F.lit(0).alias("rule"), (-F.length("word")).alias("place"), "turn", "target", "word", F.lit("embedded_table_name").alias("pattern"))


def _formed_names(names: DataFrame, columns: DataFrame) -> DataFrame:
    """The forms in their order whose word names a table, in any of the word's forms in their order."""
    matched = [F.struct(F.lit(n).alias("form"), F.lit(name).alias("pattern"), F.regexp_extract("c", form, 1).alias("word")) for n, (name, form) in enumerate(FORMS)]
    asked = names.select("c", F.explode(F.array(*matched)).alias("f")).select("c", "f.*").where(F.length("word") >= 3)
    cut = lambda n, more="": F.concat(F.expr(f"substring(word, 1, length(word) - {n})"), F.lit(more))
    ends = lambda x: F.col("word").endswith(x) & (F.length("word") > len(x))
    tries = [F.col("word"), *(F.concat("word", F.lit(x)) for x in ("s", "es", "ies")), F.when(ends("ies"), cut(3, "y")), F.when(ends("es"), cut(2)), F.when(ends("s"), cut(1)), F.when(F.col("word").endswith("y"), cut(1, "ies"))]
    tables = columns.groupBy(F.lower("table_name").alias("name")).agg(F.max("table_name").alias("target"))
    tried = asked.select("*", F.posexplode(F.array(*tries)).alias("try", "name")).join(_few(tables, "names"), "name")
    by_form = tried.groupBy("c", "form", "pattern", "word").agg(F.min(F.struct("try", "target"))["target"].alias("target"))
    none = F.lit(None).cast("struct<table_name:string,kind:int>")
    return by_form.select("c", F.lit(1).alias("rule"), F.col("form").alias("place"), none.alias("turn"), "target", "word", "pattern")


def _first_other(free: DataFrame, candidates: DataFrame) -> DataFrame:
    """``free`` with the first candidate of its name, as x, that is another table's; rows that have none fall away.

    A name has no more candidates than parts, so one list holds them; the first and
    the first of another target are enough, as one table at most is the column's own.
    """
    listed = candidates.groupBy("c").agg(F.array_sort(F.collect_set(F.struct(*_CANDIDATE))).alias("all")).withColumn("first", F.col("all")[0])
    two = listed.select("c", "first", F.get(F.filter("all", lambda x: x["target"] != F.col("first.target")), F.lit(0)).alias("other"))
    picked = F.when(F.col("first.target") != F.col("table_name"), F.col("first")).otherwise(F.col("other"))
    return free.join(two, "c").withColumn("x", picked).drop("first", "other").where("x is not null")


def links_df(columns: DataFrame, key_suffix: bool = False) -> DataFrame:
    """table_name, column_name, target, target_column, pattern, confidence: ``implicit_links`` as joins.

    The rules run over the different names of columns; each column then takes its name's first candidate of another table.
    """
    tails = (*KEY_TAILS, "key", "_key") if key_suffix else KEY_TAILS
    free = columns.where("not is_primary_key and not is_foreign_key").select("table_name", "column_name", "data_type", F.lower("column_name").alias("c"))
    names = free.select("c").distinct()
    hits = _first_other(free, _embedded_names(names, columns, tails).unionByName(_formed_names(names, columns)))
    hits = hits.select("table_name", "column_name", "data_type", "c", "x.target", "x.word", "x.pattern")
    keys = columns.where("is_primary_key").groupBy(F.col("table_name").alias("of")).agg(F.min(F.struct("position", "column_name", "data_type")).alias("key"))
    made = hits.join(_few(keys, "keys"), F.col("target") == F.col("of"), "left")
    a, b, word, name = F.lower("data_type"), F.lower("key.data_type"), F.col("word"), F.lower("target")
    same = (a == b) | (a.contains("int") & b.contains("int"))
    score = F.when(same, 2).otherwise(0) + F.when(word == name, 2).when(F.concat(word, F.lit("s")) == name, 1).otherwise(0) + F.col("c").endswith("id").cast("int")
    sure = F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")
    return made.select("table_name", "column_name", "target", F.coalesce("key.column_name", F.lit("id")).alias("target_column"), "pattern", sure.alias("confidence"))


def embedded_links_df(columns: DataFrame, tails: tuple[str, ...] = KEY_TAILS) -> DataFrame:
    """table_name, column_name, target: the embedded-name rule alone."""
    free = columns.where("not is_primary_key and not is_foreign_key").select("table_name", "column_name", F.lower("column_name").alias("c"))
    hits = _first_other(free, _embedded_names(free.select("c").distinct(), columns, tails))
    return hits.select("table_name", "column_name", "x.target")


def copies_df(columns: DataFrame) -> DataFrame:
    """table_name, column_name, likely_source: ``copied_columns`` as joins."""
    kind = F.lower("data_type")
    free = columns.where(kind.contains("char") | kind.contains("text") | kind.contains("string")).select("table_name", "column_name", F.lower("column_name").alias("c"))
    telling = F.col("tail").isin("", "name", "title", "desc", "description")
    for word in TEXT_WORDS:
        telling = telling | F.col("c").contains(word)
    hits = _name_words(free.select("c").distinct(), columns).where(telling)
    ranked = hits.select("c", F.lit(0).alias("rule"), (-F.length("word")).alias("place"), "turn", "target", "word", F.lit(None).cast("string").alias("pattern"))
    return _first_other(free, ranked).select("table_name", "column_name", F.col("x.target").alias("likely_source"))


def verify_link(spark: SparkSession, link: InferredLink) -> dict:
    """What the data say of a link: share of orphans, and whether the target column is unique."""
    child = spark.table(link.table).where(F.col(link.column).isNotNull()).select(F.col(link.column).alias("v"))
    parent = spark.table(link.target).select(F.col(link.target_column).alias("v"))
    total = child.count()
    orphans = child.join(parent.distinct(), "v", "left_anti").count()
    repeated = parent.groupBy("v").count().where("count > 1").limit(1).count()
    return {"orphan_rate": orphans / total if total else 0.0, "target_unique": repeated == 0}
