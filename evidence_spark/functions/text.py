"""Text rules as Spark column expressions (JVM-side, no Python UDF).

Whitespace follows Python's ``str`` definition: Java's ``(?U)\\s`` plus the four
separators U+001C..U+001F, spelled out in ``WHITESPACE``. Spark's ``trim`` without a list
of characters removes only U+0020 and is never used as a general strip here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The quote markers of the answer format. They must equal the
# markers the evaluated models were trained to emit.
BEGIN_MARKER = "##begin_quote##"
END_MARKER = "##end_quote##"
# ---------------------------------------------------------------------------

# The characters of (?U)[\s\x1c-\x1f]; a class that lists them is matched faster.
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WS_CLASS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_WS_RUN = WS_CLASS + "+"
_BOM = "\ufeff"

# Non-greedy block, dot matches newline, whitespace around the content excluded.
QUOTE_PATTERN = (
    r"(?s)" + BEGIN_MARKER + WS_CLASS + r"*(.*?)" + WS_CLASS + r"*" + END_MARKER
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """Empty string -> NULL (Python truthiness for strings)."""
    c = _col(c)
    return F.when(c == "", F.lit(None)).otherwise(c)


def py_strip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    """True when NULL or only whitespace (``not s or not s.strip()``)."""
    c = _col(c)
    return c.isNull() | (py_strip(c) == "")


def remove_whitespace(c) -> Column:
    return F.regexp_replace(_col(c), WS_CLASS, "")


def _overlapping(c: Column) -> Column:
    """Two markers share one or two number signs, as in ``##begin_quote##end_quote##``."""
    near = [c.contains(f"_quote{sign}{marker}") for sign in ("", "#") for marker in (BEGIN_MARKER, END_MARKER)]
    return near[0] | near[1] | near[2] | near[3]


def _closed(c: Column) -> Column:
    """The text up to its last end marker: every block ends there or before. Begin markers after it
    would each be tried to the end of the text."""
    rest = F.length(F.substring_index(c, END_MARKER, -1))
    return F.when(c.contains(END_MARKER), F.substring(c, F.lit(1), F.length(c) - rest)).otherwise(F.when(c.isNotNull(), F.lit("")))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named: as a variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_quotes(c) -> Column:
    """Quoted blocks in order, inner edges stripped, empty ones removed.

    NULL and '' give an empty array, never NULL.
    """
    c = _col(c)
    # A block runs from the first begin marker since the last block to the next end marker. Where
    # markers overlap, the pattern decides which of them counts.
    closed = _once(F.split(c, END_MARKER), lambda parts: F.slice(parts, 1, F.size(parts) - 1))
    opened = F.filter(closed, lambda p: p.contains(BEGIN_MARKER))
    split = F.transform(opened, lambda p: py_strip(F.substring(p, F.instr(p, F.lit(BEGIN_MARKER)) + len(BEGIN_MARKER), F.length(p))))
    # The pattern puts the same whitespace class on both sides of the lazy group, so a
    # group never starts or ends with whitespace: stripping it again would be a no-op.
    matched = F.regexp_extract_all(_closed(c), F.lit(QUOTE_PATTERN), F.lit(1))
    kept = F.filter(F.when(_overlapping(c), matched).otherwise(split), lambda q: q != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def format_score(c) -> Column:
    """1.0 when the text is one or more blocks separated only by whitespace.

    The text is first stripped of whitespace, then of byte-order marks at both ends.
    Gaps between blocks (and before/after) must be whitespace only; empty blocks are
    valid format even though they parse to no quote.
    """
    c = _col(c)
    # The edges are stripped in the first and last part only: both end at a marker, so this strips
    # what the strip of the whole text does, without a copy of it.
    first = F.substring_index(c, END_MARKER, 1)
    before = F.ltrim(F.ltrim(F.substring_index(first, BEGIN_MARKER, 1), F.lit(WHITESPACE)), F.lit(_BOM))
    after = F.rtrim(F.rtrim(F.substring_index(c, END_MARKER, -1), F.lit(WHITESPACE)), F.lit(_BOM))
    # before each end marker: whitespace, a begin marker, anything; after the last: whitespace
    inner = _once(F.split(c, END_MARKER), lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    blocks = F.forall(inner, lambda p: p.contains(BEGIN_MARKER) & (py_strip(F.substring_index(p, BEGIN_MARKER, 1)) == ""))
    split = c.contains(END_MARKER) & first.contains(BEGIN_MARKER) & (py_strip(before) == "") & (py_strip(after) == "") & blocks
    s1 = F.btrim(py_strip(c), F.lit(_BOM))
    head = _closed(s1)
    matched = (
        head.rlike(QUOTE_PATTERN)
        & (py_strip(F.substring_index(s1, END_MARKER, -1)) == "")
        & (remove_whitespace(F.regexp_replace(head, QUOTE_PATTERN, "")) == "")
    )
    valid = F.when(_overlapping(c), matched).otherwise(split)
    return F.when(valid, F.lit(1.0)).otherwise(F.lit(0.0))


def tokenize(c) -> Column:
    """Unicode lower case, split on whitespace runs, no empty tokens."""
    return F.array_remove(F.split(F.lower(_col(c)), _WS_RUN), "")


def question_key(c) -> Column:
    """T4: normalised question used for novelty checks (strip, then lower)."""
    return F.lower(py_strip(_col(c)))


def quote_block(c) -> Column:
    """Wrap a text as one answer block (used by prompts and fixtures)."""
    return F.concat(F.lit(BEGIN_MARKER + " "), _col(c), F.lit(" " + END_MARKER))


def normalize_variant(v) -> Column:
    """P2 on a variant value: NULL / JSON null -> NULL; string -> the string; array ->
    concatenation of the ``text`` field of its object items (missing field -> ''), or
    the array's JSON text when it has no object item; anything else -> its JSON text.
    (The original used Python's ``str()`` for the last two cases; JSON text is the
    portable equivalent.)
    """
    v = _col(v)
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    objects = F.filter(items, lambda it: F.schema_of_variant(it).startswith("OBJECT"))
    texts = F.transform(
        objects, lambda it: F.coalesce(F.try_variant_get(it, "$.text", "string"), F.lit(""))
    )
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.startswith("ARRAY") & (F.size(objects) > 0), F.array_join(texts, ""))
        .otherwise(F.to_json(v))
    )


def normalize_text(json_text) -> Column:
    """P2 on JSON text (see :func:`normalize_variant`)."""
    return normalize_variant(F.try_parse_json(_col(json_text)))
