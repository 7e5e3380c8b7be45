"""The search projection: documents of symbols and files, deletion by path, partners, postings by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.naming import camel_parts, snake_parts
from codeloom.functions.paths import basename
from codeloom.functions.text import truncate_bytes

#: Bytes of a body that the projection keeps; the catalogue has the whole text.
BODY_BYTES = 2000
#: Tables that hang on files, each before what it refers to, with the column that names the file.
CASCADE = (("type_arguments", "file_path"), ("source_regions", "file_path"), ("identifiers", "file_path"), ("symbols", "file_path"), ("files", "path"))


def pretokenized(text: Column) -> Column:
    """F12 in the JVM: each word followed by its camel and snake parts that differ from it in more than case."""
    def parts(w: Column) -> Column:
        mixed = (F.lower(w) != w) & (F.upper(w) != w)
        camel = F.when(mixed, camel_parts(w)).otherwise(F.array().cast("array<string>"))
        snake = F.when(F.instr(w, "_") > 0, snake_parts(w)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(w), F.filter(F.concat(camel, snake), lambda p: (p != "") & (F.lower(p) != F.lower(w))))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.flatten(F.transform(words, parts)), " ")


def symbol_documents(symbols: DataFrame) -> DataFrame:
    """A search document per symbol (id, name, signature, doc_comment, code_context, file_path): body cut to :data:`BODY_BYTES` bytes between characters, name, signature and body pretokenised."""
    body = truncate_bytes(F.coalesce("code_context", F.lit("")), BODY_BYTES)
    return symbols.select(F.lit("symbol").alias("doc_type"), F.col("id").alias("key"), "file_path", "name", body.alias("body"), F.lit("").alias("path_text"), pretokenized(F.concat_ws(" ", "name", "signature", body)).alias("pretokenized"))


def file_documents(files: DataFrame) -> DataFrame:
    """A search document per file (path, content): its name without the last extension, the first :data:`BODY_BYTES` bytes pretokenised; the content stays in the catalogue."""
    body = truncate_bytes(F.coalesce("content", F.lit("")), BODY_BYTES)
    return files.select(F.lit("file").alias("doc_type"), F.col("path").alias("key"), F.col("path").alias("file_path"), F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "").alias("name"), body.alias("body"), F.col("path").alias("path_text"), pretokenized(body).alias("pretokenized"))


def delete_paths(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """The documents without those of some files (file_path)."""
    return documents.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def partner_paths(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The files (file_path) whose documents must be made again once the edges of some files (file_path) change: those of the changed files and of every symbol at the other end of one of their edges."""
    s = symbols.select("id", "file_path")
    inside = s.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("id")
    ends = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    partners = ends.join(inside.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    return s.join(partners, "id", "left_semi").select("file_path").unionByName(changed.select("file_path")).distinct()


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Tables without what hangs on some files (file_path), in the order in which rows may go."""
    gone = paths.select(F.col("file_path").alias("__gone")).distinct()
    return {name: tables[name].join(gone, F.col(column) == F.col("__gone"), "left_anti") for name, column in CASCADE if name in tables}
