"""Context assembly: pivots, budgets, packing, truncation, diffs and edits.

These work on the few rows of one request, on the driver, as the ranking before them is what is distributed.
"""

from __future__ import annotations

import difflib
import re

#: Token budgets by the number of pivots, their split, and the multipliers of task signals.
BUDGETS = {1: 2000, 2: 3000, 3: 4000}
SPLIT = (0.60, 0.30, 0.10)
SIGNALS = {"edited": 2.5, "entry": 3.0, "stack": 2.0, "near_line": 1.5, "symbol": 1.5, "failing_test": 2.5}
STEPS = (100, 75, 50, 30, 20, 10, 5)


def estimate(text: str) -> int:
    return -(-len(text) // (2 if re.search("[぀-ヿ㐀-䶿一-鿿가-힯]", text) else 4))


def pivot_count(scores: list[float]) -> int:
    """One pivot if the first score is twice the second, three if the third is at least 0.7 of the first, else two."""
    if len(scores) < 2 or scores[0] >= 2 * scores[1]:
        return min(1, len(scores))
    return 3 if len(scores) > 2 and scores[2] >= 0.7 * scores[0] else 2


def allocate(pivots: int) -> dict[str, int]:
    """J18."""
    total = BUDGETS[max(1, min(3, pivots))]
    return dict(zip(("pivots", "neighbours", "summary"), (int(total * s) for s in SPLIT)))


def pack(entries: list[str], tokens: int) -> tuple[list[int], list[int]]:
    """First fit: (kept, spilled) places; what doesn't fit is skipped and later smaller ones may still fit; the first is always kept."""
    room, kept, spilled = max(800, 4 * tokens), [], []
    for i, e in enumerate(entries):
        if not kept or len(e) <= room:
            kept.append(i)
            room -= len(e)
        else:
            spilled.append(i)
    return kept, spilled


def reduce(items: list[str], tokens: int) -> list[str]:
    """The largest of fixed shares of the items whose estimate fits; at least one item."""
    for p in STEPS:
        part = items[: max(1, len(items) * p // 100)]
        if sum(map(estimate, part)) <= tokens:
            return part
    return items[:1]


def head_tail(code: str, tokens: int) -> str:
    """Two thirds of the head and one third of the tail within a budget of at least five lines."""
    lines = code.split("\n")
    if estimate(code) <= tokens:
        return code
    per = max(1.0, estimate(code) / len(lines))
    keep = max(5, int(tokens / per))
    if keep >= len(lines):
        return code
    head = keep * 2 // 3
    tail = keep - head
    return "\n".join([*lines[:head], f"... {len(lines) - keep} lines omitted ...", *lines[len(lines) - tail:]])


def strip_comments(body: str) -> str:
    """Comments and string contents blanked, line breaks kept."""
    out, i, n = [], 0, len(body)
    while i < n:
        if body.startswith("//", i) or (body[i] == "#" and (i == 0 or body[i - 1] in " \t\n")):
            end = body.find("\n", i)
            i = n if end < 0 else end
        elif body.startswith("/*", i):
            end = body.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append("\n" * body.count("\n", i, end))
            i = end
        elif body[i] in "\"'`":
            q, j = body[i], i + 1
            while j < n and body[j] != q and not (q != "`" and body[j] == "\n"):
                j += 2 if body[j] == "\\" else 1
            out.append(q + "\n" * body.count("\n", i, min(j, n)) + (q if j < n else ""))
            i = j + 1
        else:
            out.append(body[i])
            i += 1
    return "".join(out)


def signal_factor(signals: set[str]) -> float:
    """J16."""
    out = 1.0
    for s in signals:
        out *= SIGNALS.get(s, 1.0)
    return out


def unified_diff(before: str, after: str, path: str) -> str:
    """J22."""
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))


#: Characters of a text up to which it is searched for with slips, and how like it a place must be.
FUZZY_CHARS, FUZZY_RATIO = 32, 0.8


def edit(text: str, old: str, new: str, occurrence: str = "first") -> str:
    """Exact, else line by line without outer space, else (short texts) the place that is most like it; the first, last or every occurrence. Raises ValueError if it isn't there."""
    if not old:
        raise ValueError("nothing to replace")
    if old in text:
        if occurrence == "all":
            return text.replace(old, new)
        at = text.find(old) if occurrence == "first" else text.rfind(old)
        return text[:at] + new + text[at + len(old):]
    lines, want = text.split("\n"), [x.strip() for x in old.split("\n")]
    hits = [i for i in range(len(lines) - len(want) + 1) if [x.strip() for x in lines[i:i + len(want)]] == want]
    if hits:
        for i in reversed(hits if occurrence == "all" else [hits[0] if occurrence == "first" else hits[-1]]):
            lines[i:i + len(want)] = new.split("\n")
        return "\n".join(lines)
    if len(old) <= FUZZY_CHARS:
        like = [(difflib.SequenceMatcher(None, old, text[i:i + len(old)], autojunk=False).ratio(), -i) for i in range(max(1, len(text) - len(old) + 1))]
        best, place = max(like)
        if best >= FUZZY_RATIO:
            return text[:-place] + new + text[-place + len(old):]
    raise ValueError("the text to replace isn't there")


def rename(text: str, old: str, new: str) -> str:
    """Whole identifiers alone."""
    return re.sub(rf"(?<![\w$]){re.escape(old)}(?![\w$])", new, text)


OPERATIONS = ("replace_full", "replace_body", "replace_signature", "insert_before", "insert_after", "add_doc")


def rewrite_span(text: str, start: int, end: int, body: str, operation: str = "replace_full", body_start: int | None = None, body_end: int | None = None) -> str:
    """Replaces a symbol's bytes, its body's or what comes before its body, or puts text before or after it, or a comment before its line.

    Places are UTF-8 bytes. ValueError for an unknown operation, or for one on the body of a symbol that has none.
    """
    if operation not in OPERATIONS:
        raise ValueError(operation)
    if operation in ("replace_body", "replace_signature") and (body_start is None or body_end is None):
        raise ValueError(f"{operation} needs a body")
    raw, new = text.encode(), body.encode()
    if operation == "add_doc":
        line = raw.rfind(b"\n", 0, start) + 1
        indent = raw[line:start] if raw[line:start].isspace() else b""
        new = b"".join(indent + x + b"\n" for x in new.split(b"\n"))
        start = end = line
    elif operation == "replace_body":
        start, end = body_start, body_end
    elif operation == "replace_signature":
        end = body_start
    elif operation == "insert_before":
        end = start
    elif operation == "insert_after":
        start = end
    return (raw[:start] + new + raw[end:]).decode()


def rename_in_files(files, uses, old: str, new: str):
    """J12 over the catalogue: (path, content, replaced) of every file that refers to a name (uses: name, file_path), with the name replaced wherever it stands as a whole word."""
    from pyspark.sql import functions as F

    pattern = rf"\b{re.escape(old)}\b"
    touched = uses.filter(F.col("name") == old).select(F.col("file_path").alias("path")).distinct()
    rows = files.filter(F.col("content").isNotNull()).join(touched, "path", "left_semi").withColumn("replaced", F.regexp_count("content", F.lit(pattern)))
    return rows.filter("replaced > 0").select("path", F.regexp_replace("content", pattern, new.replace("\\", "\\\\").replace("$", "\\$")).alias("content"), "replaced")


def smart_truncate(lines: list[str], most: int) -> str:
    """Keeps declarations, returns and the first and last lines before others, in their order, marking gaps."""
    if len(lines) <= most:
        return "\n".join(lines)
    key = re.compile(r"^\s*(?:pub|def|fn|func|class|struct|interface|impl|trait|enum|return|raise|throw|export|async)\b|[{}]\s*$")
    order = sorted(range(len(lines)), key=lambda i: (i not in (0, len(lines) - 1), not key.search(lines[i]), i))
    keep = sorted(order[:most])
    out: list[str] = []
    for n, i in enumerate(keep):
        if n and i != keep[n - 1] + 1:
            out.append("...")
        out.append(lines[i])
    return "\n".join(out)


def inject_seeds(scores: dict[str, float], explicit: set[str], stack: set[str], in_files: set[str]) -> dict[str, float]:
    """Symbols that a task names score at least 1 or the best score, those of its stack trace 0.75, those of its files 0.35; the larger score stays."""
    top = max([1.0, *scores.values()])
    out = dict(scores)
    for ids, score in ((explicit, top), (stack, 0.75), (in_files, 0.35)):
        for i in ids:
            out[i] = max(out.get(i, 0.0), score)
    return out
