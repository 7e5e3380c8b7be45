"""Queries of this subpackage for the driver contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.llm import bpe, functions, generated, language, packing, quantiles, syntax
from codeloom.llm.sql import ORACLES
from codeloom.sources.tables import current_rows, table

__all__ = ["ORACLES", "QUERIES"]


def _calls(spark, d, *columns):
    """The tool calls, once per id."""
    return current_rows(table(spark, d, "tool_calls"), "id", list(columns), "called_at")


def p2_percentiles(spark, d):
    """Percentiles of duration_ms by tool, by workspace, by both and over all, rolled up from sketches of tasks."""
    keys = ["tool_name", "workspace_id"]
    parts = quantiles.partial_sketches(_calls(spark, d, *keys, "duration_ms"), keys, "duration_ms")
    fine = quantiles.merge_sketches(parts, keys)
    sets = {"tool": ["tool_name"], "workspace": ["workspace_id"], "both": keys, "all": []}
    return quantiles.read_percentiles(quantiles.roll_up(fine, keys, sets))


def _days(spark, d):
    keys = ["day", "tool_name", "workspace_id"]
    calls = _calls(spark, d, "tool_name", "workspace_id", "duration_ms").withColumn("day", F.to_date("called_at"))
    return quantiles.group_sketches(calls, keys, "duration_ms")


def p2_days(spark, d):
    """Percentiles per day, tool and workspace, the finest partial results that there are."""
    return quantiles.read_percentiles(_days(spark, d), {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def p2_sketches(spark, d):
    """The same with the sketches themselves, from which any coarser percentiles can be combined."""
    return quantiles.read_percentiles(_days(spark, d), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keep_sketch=True)


def p2_weeks(spark, d):
    """Percentiles of duration_ms by tool and week, combined from one sketch per tool and day."""
    calls = _calls(spark, d, "tool_name", "duration_ms").withColumn("day", F.to_date("called_at"))
    days = quantiles.group_sketches(calls, ["tool_name", "day"], "duration_ms")
    weeks = days.select("tool_name", F.to_date(F.date_trunc("week", "day")).alias("week"), "sketch")
    return quantiles.read_percentiles(quantiles.merge_sketches(weeks, ["tool_name", "week"]))


#: Section size of the sketches that p2_bounds checks: so small that most groups of the test data compact, many times.
BOUNDS_K = 16


def p2_bounds(spark, d):
    """Whether each percentile by tool, workspace and over all lies within the stated error of its true rank, and whether its sketch has compacted.

    Sketches with sections of 16 instead of 64, so that groups from 96 values on compact; ranks are counted over all values.
    """
    keys = ["tool_name", "workspace_id"]
    calls = _calls(spark, d, *keys, "duration_ms")
    fine = quantiles.merge_sketches(quantiles.partial_sketches(calls, keys, "duration_ms", BOUNDS_K), keys)
    sets = {"tool": ["tool_name"], "workspace": ["workspace_id"], "all": []}
    return quantiles.check_bounds(quantiles.roll_up(fine, keys, sets), calls.filter("duration_ms is not null and not isnan(duration_ms)"), keys, sets, "duration_ms", BOUNDS_K)


def p4_found(spark, d):
    return syntax.check_syntax(table(spark, d, "files")).filter(~F.col("valid")).select("path")


def p4_report(spark, d):
    """Every broken file with the furthest place that fits no grammar, and why."""
    return syntax.check_syntax(table(spark, d, "files")).filter(~F.col("valid"))


def p4_rates(spark, d):
    return syntax.rates(syntax.check_syntax(table(spark, d, "files")))


def p4_json(spark, d):
    """The verdict on every JSON file."""
    return syntax.check_syntax(table(spark, d, "files")).filter("language = 'json' and valid is not null").select("path", "valid")


def p5_found(spark, d):
    return generated.classify(table(spark, d, "files")).filter("reason is not null").select("path")


def p5_layout(spark, d):
    """Every current file with its layout statistics and the reason why it isn't hand-written."""
    return generated.classify(table(spark, d, "files"))


def p5_statistics(spark, d):
    """The layout statistics that plain SQL can count too."""
    return generated.classify(table(spark, d, "files")).select("path", "chars", "lines", "max_line", "space_share", "alnum_share")


def p7_found(spark, d):
    return functions.documented_functions(table(spark, d, "symbols"), texts=False).select("symbol_id")


def p7_pairs(spark, d):
    """Code and description of documented functions, without the corpus's repeated templates."""
    return functions.pairs(functions.documented_functions(table(spark, d, "symbols")))


def p7_functions(spark, d):
    """Functions extracted from the files themselves, broken ones included, with their documentation."""
    return functions.functions_of_files(table(spark, d, "files"))


def p8_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


def p8_roundtrip(spark, d):
    """Per document the bytes of its text and whether its ids spell it again."""
    docs = table(spark, d, "documents")
    return bpe.roundtrip(bpe.encode(docs.select("doc_id", "text"), keep_text=True))


def _packed(spark, d):
    sizes = bpe.encode(table(spark, d, "documents"), counts_only=True)
    return packing.pack(sizes)


def p9_pack(spark, d):
    """Each document, or piece of one longer than 2,048 tokens, with its container."""
    return _packed(spark, d)


def p9_fill(spark, d):
    return packing.fill_report(_packed(spark, d))


def p9_steps(spark, d):
    return packing.step_report(_packed(spark, d))


#: Capacity of p9_lengths, in characters.
LENGTHS_CAPACITY = 4096


def p9_lengths(spark, d):
    """The same packing by lengths in characters, checked as a whole: pieces, their sum, faults, and whether unused space is within 1 % of the least possible."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("tokens"))
    return packing.check(packing.pack(docs, capacity=LENGTHS_CAPACITY), LENGTHS_CAPACITY)


def p10_found(spark, d):
    return language.mislabelled(language.segment(table(spark, d, "documents"))).select("doc_id", "lang")


def p10_segments(spark, d):
    """Every document's stretches of one language, with place, words and confidence."""
    return language.stretches(table(spark, d, "documents"))


def p10_places(spark, d):
    """Per document whether its stretches are in order, apart and of a confidence between 0 and 1, and whether they lie within the text."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars"))
    return language.check_places(language.stretches(table(spark, d, "documents")), docs)


QUERIES = {
    f.__name__: f
    for f in (
        p2_percentiles, p2_days, p2_sketches, p2_weeks, p2_bounds, p4_found, p4_report, p4_rates, p4_json, p5_found, p5_layout, p5_statistics,
        p7_found, p7_pairs, p7_functions, p8_ids, p8_roundtrip, p9_pack, p9_fill, p9_steps, p9_lengths, p10_found, p10_segments, p10_places,
    )
}
