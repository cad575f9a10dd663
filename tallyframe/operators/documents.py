"""JSON documents as typed paths, and what changed from one document to another."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of nesting; a deeper document is an error.
DEEPEST = 100


def canonical_json(document: Column) -> Column:
    """A document's text with sorted fields and no spaces between them, the same for equal documents."""
    return F.to_json(F.parse_json(document))


def _kind(node: Column) -> Column:
    shape = F.schema_of_variant(node)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")


def _step(path: Column, name: Column, place: Column) -> Column:
    """The path of a child: .name, or ["name"] if it is no plain word, or [place]."""
    quoted = F.concat(F.lit('["'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    plain = F.concat(F.when(path == "", "").otherwise("."), name)
    return F.concat(path, F.when(name.isNull(), F.concat(F.lit("["), place.cast("string"), F.lit("]"))).when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), plain).otherwise(quoted))


def _depth(document: Column) -> Column:
    """How deep the brackets of a text are nested, those in strings left out; 0 for a null."""
    marks = F.translate(F.regexp_replace(document, r'"(?:[^"\\]++|\\.)*+"', ""), "[]", "{}")
    marks = F.split(F.regexp_replace(marks, "[^{}]++", ""), "")
    deeper = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: F.struct((now := a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(a["most"], now).alias("most")))
    return F.coalesce(deeper["most"], F.lit(0))


def _leaves(documents: DataFrame, by: list[str], levels: int) -> DataFrame:
    """by, path, kind, value of documents (by, _text) of so many levels. A document is parsed once; at each level an object or an
    array gives its children, and all else, an empty one included, stays as it is."""
    spark = documents.sparkSession
    nodes = documents.where("_text IS NOT NULL").select(*by, F.lit("").alias("path"), F.try_parse_json("_text").alias("node"), "_text")
    nodes = nodes.select(*by, "path", "node", F.when(F.col("node").isNull(), F.col("_text")).alias("_bad"))
    for _ in range(levels):
        children = nodes.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))
        inner = F.col("pos").isNotNull()
        nodes = children.select(*by, F.when(inner, _step(F.col("path"), F.col("key"), F.col("pos"))).otherwise(F.col("path")).alias("path"), F.when(inner, F.col("value")).otherwise(F.col("node")).alias("node"), "_bad")
    bad = F.col("_bad").isNotNull()
    return nodes.select(*by, "path", F.when(bad, "unreadable").otherwise(_kind(F.col("node"))).alias("kind"), F.when(bad, F.col("_bad")).otherwise(F.to_json("node")).alias("value"))


def _levels(texts: DataFrame) -> int:
    """The levels of the deepest of texts (_text) that can be read."""
    most = texts.agg(F.max(_depth(F.col("_text")))).first()[0] or 0
    if most > DEEPEST:  # brackets of a text that is no JSON do not count
        most = texts.where(F.try_parse_json("_text").isNotNull()).agg(F.max(_depth(F.col("_text")))).first()[0] or 0
    if most > DEEPEST:
        raise ValueError(f"a document has more than {DEEPEST} levels")
    return most


def paths(documents: DataFrame, by: list[str], document: str = "document") -> DataFrame:
    """by, path, kind, value: of every scalar, and every empty object or array, of each document; value is its JSON text.

    A null document has no paths; a text that is no JSON is one path, empty, of the kind `unreadable`. Each level of nesting is
    one step of the plan; a pass over the texts' brackets tells how many there are.
    """
    texts = documents.select(*by, F.col(document).alias("_text"))
    return _leaves(texts, by, _levels(texts))


def changes(before: DataFrame, after: DataFrame, by: list[str], document: str = "document") -> DataFrame:
    """by, path, change, old_kind, old_value, new_kind, new_value: a row for each path that was added, removed or changed, in
    kind or value, between the documents of one key; each key has one document on either side at most, or none.

    Documents of a key are brought together before they are taken apart, so that paths are not shuffled.
    """
    old, new = (x.select(*by, F.lit(side).alias("_new"), F.col(document).alias("_text")).where("_text IS NOT NULL") for side, x in ((False, before), (True, after)))
    levels = max(_levels(old), _levels(new))
    # A number of its own: a union of sides that are partitioned by the key already would pass for partitioned by it, although
    # the parts of its sides may be merged differently, and the repartition would be dropped.
    parts = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    together = old.unionByName(new).repartition(parts, *[F.col(c) for c in by])
    sides = _leaves(together, [*by, "_new"], levels).groupBy(*by, "path").agg(*[F.max(F.when(F.col("_new") == new, F.struct("kind", "value"))).alias(name) for name, new in (("_old", False), ("_now", True))])
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_old") != F.col("_now"), "changed")
    return sides.select(*by, "path", change.alias("change"), F.col("_old.kind").alias("old_kind"), F.col("_old.value").alias("old_value"), F.col("_now.kind").alias("new_kind"), F.col("_now.value").alias("new_value")).where("change IS NOT NULL")


def write_documents(documents: DataFrame, path: str) -> None:
    """Keep documents (name, document) as lines of JSON with sorted fields, so that equal documents are equal bytes."""
    named = F.to_json(F.array("name"))  # ["..."], whose brackets go
    line = F.concat(F.lit('{"name":'), F.substr(named, F.lit(2), F.length(named) - 2), F.lit(',"document":'), canonical_json(F.col("document")), F.lit("}"))
    documents.select(line.alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, document) of what write_documents() kept; nothing if nothing was ever kept there."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    node = F.parse_json("value")
    return lines.select(F.variant_get(node, "$.name", "string").alias("name"), F.to_json(F.variant_get(node, "$.document", "variant")).alias("document"))
