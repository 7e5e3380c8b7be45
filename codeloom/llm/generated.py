"""Files that nobody wrote by hand: tool output, minified scripts, copies of libraries, data in the form of code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import current_rows

#: Characters of a run of letters and digits that no name is as long as, per line of encoded data.
RUN = 60


@dataclass(frozen=True)
class Thresholds:
    """Limits of the layout statistics beyond which a text isn't hand-written."""

    min_chars: int = 300  # shorter texts tell too little
    mean_line: float = 200.0  # minified: mean line length with
    space_share: float = 0.09  # white space below this
    number_density: float = 0.30  # data: numeric literals among all tokens
    encoded_share: float = 0.5  # data: characters in encoded runs
    alnum_share: float = 0.9  # encoded text is nearly all letters and digits


#: Tuned per language; Go and Python indent deeply or by tabs; in TOML a key with a number is three tokens, so that settings come near a third.
TUNED = {
    "javascript": Thresholds(mean_line=150.0, space_share=0.10),
    "typescript": Thresholds(mean_line=150.0, space_share=0.10),
    "java": Thresholds(),
    "rust": Thresholds(),
    "go": Thresholds(space_share=0.08),
    "python": Thresholds(mean_line=250.0),
    "json": Thresholds(),
    "toml": Thresholds(mean_line=250.0, space_share=0.05, number_density=0.40),
}

# Names of folders and files, and wordings that tools and libraries put at the head of files.
VENDOR_FOLDERS = r"(?i)(^|/)(node_modules|bower_components|vendor|vendored|third[_-]?party|3rd[_-]?party|extern|externals|external|site-packages|dist-packages|jspm_packages|Godeps|Pods)/"
GENERATED_FOLDERS = r"(?i)(^|/)(generated|__generated__|generated[-_]sources|auto[-_]?generated|target/gen|build/gen|gen-src)/"
GENERATED_NAMES = r"(?i)(\.(g|gen|generated|pb|pb\.gw|designer|freezed)\.\w+$|_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h)$|_generated\.\w+$|\.g\.dart$)"
LOCK_NAMES = r"(?i)(^|/)([\w.-]*-lock\.(json|ya?ml)|[\w.-]*\.lock(\.json|file)?|npm-shrinkwrap\.json|go\.sum|Gopkg\.lock)$"
MINIFIED_NAMES = r"(?i)([.-]min\.(m?js|css)$|(^|/)bundle\.\w+\.js$|\.(bundle|chunk)\.js$)"
BANNERS = (
    r"generated\s+(code|file|source)s?\b.{0,60}(do\s+not|don't|instead|edit|change|lost|overwritten)",
    r"\bgenerated\s+by\b.{0,80}",
    r"\bauto-?\s?generated\s+(by|from|file|code|source)\b",
    r"\bautomatically\s+generated\b",
    r"<auto-?generated\s*/?>",
    r"@generated\b",
    r"\bgenerated\s+from\b.{0,80}(do\s+not|don't|on\s+build|edit|modify)",
    r"\bmachine[- ]generated\b",
    r"\bthis\s+is\s+an?\s+(auto-?)?generated\s+file\b",
    r"\bdo\s+not\s+(edit|modify)\b.{0,40}\bgenerated\b",
    r"\bautomatisch\s+(erzeugt|generiert)\b",
    r"\b(généré|genere)\s+automatiquement\b",
    r"\bgenerado\s+autom[aá]ticamente\b",
    r"\bgenerato\s+automaticamente\b",
)
#: A banner line that speaks of something smaller than the file, or of others, is no banner.
NOT_BANNERS = r"(?i)\b(method|function|constructor|getter|setter|catch block)\s+stub\b|\b(writes?|prints?|emits?|reads?|checks?|detects?|looks?|skips?|ignores?|if|when|whether|not)\b.{0,60}\bgenerated\b|\bnot\s+(auto-?)?generated\b|\bno longer\b"
NOTICES = (
    r"\bvendored\s+(copy\s+)?(of|from)\s+[\w.@/-]+\s+v?\d+\.\d+",
    r"\bcop(y|ied)\s+(of|from)\s+(upstream\s+)?[\w.@/-]+\s+(release|version)?\s*v?\d+\.\d+",
    r"\bthis\s+file\s+is\s+part\s+of\s+[\w.@/-]+\s+v?\d+\.\d+",
    r"@license\s+[\w.@/-]+?[- ]v?\d+\.\d+",
    r"^[/!*# \t\x0B\f]*[\w.@/-]++\s++v\d+\.\d+(\.\d+)?\s*$",
    r"^/\*!\s*[\w.@/-]+\s+v?\d+\.\d+",
)

#: The comment lines at a text's start, behind a shebang or a package line.
#: Possessive throughout, so that a long one takes neither stack nor backtracking.
_LEAD = r"^(?:\x{FEFF})?(?:#![^\n]*+\n)?((?:[ \t]*+(?://[^\n]*+|#(?!\[)[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*+|--[^\n]*+)?+(?:\r?\n|$))*+)"

#: A numeric literal with sign (behind no operand), fraction, exponent and type, or an escaped byte within a string: one token.
_NUMBER = r"(?=[-+.\\\d])(?:(?:(?<![\w.)\]])[+-])?(?<![\w.])(?:0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:\d[\d_]*+(?:\.(?![.\w])|\.\d[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)(?:[iuf](?:8|16|32|64|128|size)|[fFdDlLuUjJin]{1,3})?+(?!\w)|\\x[0-9a-fA-F]{2}|\\[0-3][0-7]{2})"


def _share(c: Column, drop: str, n: Column) -> Column:
    """The share of characters that ``drop`` matches."""
    return F.lit(1.0) - F.length(F.regexp_replace(c, drop, "")) / n


def layout(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds the layout statistics: chars, lines, max_line, mean_line, space_share, alnum_share, number_density, encoded_share.

    Null for null or empty contents. All are expressions of the JVM; texts are taken whole.
    """
    c = F.col(content)
    n = F.length(c)
    some = n > 0
    lengths = F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.length(x))
    words = F.regexp_count(c, F.lit(r"[^\W\d]\w*+|" + _NUMBER + r"|\w++|[^\w\s]"))
    numbers = F.regexp_count(c, F.lit(_NUMBER))
    out = files.withColumn("chars", F.when(some, n))
    out = out.withColumn("__lengths", F.when(some, lengths))
    out = out.withColumn("max_line", F.array_max("__lengths"))
    # the last line end makes no line of its own
    out = out.withColumn("lines", F.when(some, F.size("__lengths") - F.when(F.element_at("__lengths", -1) == 0, 1).otherwise(0)))
    out = out.withColumn("mean_line", F.when(F.col("lines") > 0, F.col("chars") / F.col("lines"))).drop("__lengths")
    out = out.withColumn("space_share", F.when(some, _share(c, r"\s+", n))).withColumn("alnum_share", F.when(some, _share(c, r"[\p{L}\p{N}]+", n)))
    out = out.withColumn("number_density", F.when(words > 0, numbers / words))
    # a cheap test first: most texts have no encoded run at all
    return out.withColumn("encoded_share", F.when(some, F.when(c.rlike(r"[A-Za-z0-9+/_=-]{%d}" % RUN), _share(c, r"[A-Za-z0-9+/_=-]{%d,}" % RUN, n)).otherwise(0.0)))


def _limit(language: Column, field: str) -> Column:
    out = None
    for name, t in TUNED.items():
        cond = language == name
        out = F.when(cond, getattr(t, field)) if out is None else out.when(cond, getattr(t, field))
    return out.otherwise(getattr(Thresholds(), field))


def _any(c: Column, patterns: tuple[str, ...], flags: str) -> Column:
    return c.rlike(flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def classify(files: DataFrame, key: str = "path", content: str = "content", language: str = "language", keep: tuple[str, ...] = ("workspace_id", "size", "line_count"), version: str = "last_indexed") -> DataFrame:
    """One row per current file with its layout statistics, ``reason``, null for hand-written files, and ``by_layout``, what the statistics alone say.

    Reasons, the first that holds: lock (a lock file by name), minified (long lines with little white space), encoded (long runs of letters
    and digits make up the text), data (numeric literals make up the tokens), vendored (a library's folder, or its notice at the head), generated (a tool's
    folder or file name, or its banner at the head). The head is the whole block of comments at the start, however long. Texts in the middle of a file never count, so a file that
    speaks of such things stays hand-written. Thresholds are :data:`TUNED` per language.

    Null or blank contents are judged by name alone; a null language gets the general thresholds; of repeated rows the
    greatest ``version`` counts; rows with a null key are left out; an empty table gives no rows. size and line_count are
    passed on as delivered, the statistics being counted anew.
    """
    rows = current_rows(files, key, [*keep, language, content], version)
    lang = F.lower(F.trim(F.col(language)))
    rows = layout(rows, content)
    lead = F.regexp_extract(content, _LEAD, 1)
    banner_lines = F.filter(F.split(lead, r"\r?\n"), lambda x: ~x.rlike(NOT_BANNERS))
    rows = rows.withColumn("__lead", F.array_join(banner_lines, "\n"))
    enough = F.col("chars") >= _limit(lang, "min_chars")
    minified = enough & (F.col("mean_line") > _limit(lang, "mean_line")) & (F.col("space_share") < _limit(lang, "space_share")) & (F.col("encoded_share") < _limit(lang, "encoded_share"))
    encoded = enough & (F.col("encoded_share") >= _limit(lang, "encoded_share")) & (F.col("alnum_share") >= _limit(lang, "alnum_share"))
    data = enough & (F.col("number_density") >= _limit(lang, "number_density"))
    path = F.col(key)
    vendored = path.rlike(VENDOR_FOLDERS) | _any(F.col("__lead"), NOTICES, "(?im)")
    made = path.rlike(GENERATED_FOLDERS) | path.rlike(GENERATED_NAMES) | _any(F.col("__lead"), BANNERS, "(?i)")
    by_layout = F.when(minified, "minified").when(encoded, "encoded").when(data, "data")
    reason = F.when(path.rlike(LOCK_NAMES), "lock").when(minified | path.rlike(MINIFIED_NAMES), "minified").when(encoded, "encoded").when(data, "data").when(vendored, "vendored").when(made, "generated")
    return rows.select(key, *keep, language, "chars", "lines", "max_line", *[F.round(c, 6).alias(c) for c in ("mean_line", "space_share", "alnum_share", "number_density", "encoded_share")], reason.alias("reason"), by_layout.alias("by_layout"))
