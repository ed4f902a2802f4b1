"""Column -> Column text functions. All stay in the JVM except ``compat_fold``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace characters beside the plain space, and word characters.
OTHER_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
SPACE_CLASS = f"[ {OTHER_SPACE}]"
SPACES = " " + "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
WORD_CLASS = r"[\p{L}\p{N}_]"

# Accents folded to their base letter by the full-text tokenizer.
ACCENTS = {
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü",
    "y": "ýÿ",
}

# Words that carry no content in summaries and quotes.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is",
    "of", "on", "or", "that", "the", "to", "with",
)
# Characters treated as a plain hyphen in quotes.
DASHES = "‐‑‒–—−"

SNIPPET_CHARS = 240
SNIPPET_TOKENS = 32
PAYLOAD_CHARS = 3000


def normalize_ws(text: Column) -> Column:
    """Collapse every whitespace run to one space and trim.

    Single plain spaces, nearly all runs of a text, do not match. A run begins at a character that is neither printable
    nor a plain space before a printable one: these two cheap tests come before the long classes.
    """
    run = rf"[^!-~\xA1-\u167F](?<! (?=[!-~]))(?:(?<= ){SPACE_CLASS}+|(?<=[{OTHER_SPACE}]){SPACE_CLASS}*)"
    return F.trim(F.regexp_replace(text, run, " "))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(SPACES))


def once(value: Column) -> Column:
    """The value as a stored column: an exploded one-element array is computed once a row, however often it is used."""
    return F.explode(F.array(value))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dehyphenate(text: Column) -> Column:
    """Join words broken over a line end, then join the non-empty lines."""
    joined = F.regexp_replace(text, rf"({WORD_CLASS})-\s*\n({WORD_CLASS})", "$1$2")
    kept = F.filter(F.transform(lines(joined), strip), lambda line: line != "")
    return F.array_join(kept, " ")


def word_count(normalized: Column) -> Column:
    """Words of an already normalized text."""
    spaces = F.length(normalized) - F.length(F.replace(normalized, F.lit(" "), F.lit("")))
    return F.when(normalized == "", F.lit(0)).otherwise(spaces + 1)


def tokens_of(words: Column, chars: Column) -> Column:
    """Token estimate from a word count and a character count."""
    return F.greatest(words, F.ceil(chars / 4).cast("int"))


def count_tokens(text: Column) -> Column:
    """Estimated tokens: the larger of words and a quarter of the characters."""
    normalized = normalize_ws(text)
    return tokens_of(word_count(normalized), F.length(normalized))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_CLASS}+)"), F.lit(1))


def fold_term(term: Column) -> Column:
    """Case- and accent-insensitive form of a search term or text."""
    return fold_lower(F.lower(term))


def fold_lower(low: Column) -> Column:
    """A lower-cased text without accents; texts of plain letters (as many bytes as characters) stay as they are."""
    accented = "".join(ACCENTS.values())
    plain = "".join(base * len(of) for base, of in ACCENTS.items())
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, accented, plain))


def plain_snippet(text: Column) -> Column:
    compact = normalize_ws(text)
    cut = F.concat(F.rtrim(F.substring(compact, 1, SNIPPET_CHARS - 3)), F.lit("..."))
    return F.when(F.length(compact) <= SNIPPET_CHARS, compact).otherwise(cut)


def marked_window(
    compact: Column, folded_terms: Column, first: Column, size: int = SNIPPET_TOKENS
) -> Column:
    """The ``size`` words of a normalized text from word ``first`` (from 1) on, moved back if they pass its end.

    Words with a term are marked; dots stand for what is left out.
    """
    total = word_count(compact)
    start = F.greatest(F.least(first, total - size + 1), F.lit(1))
    shown = F.transform(
        F.slice(F.split(compact, " "), start, size),
        lambda w: F.when(
            F.arrays_overlap(word_tokens(fold_term(w)), folded_terms), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))
        ).otherwise(w),
    )
    return F.concat(
        F.when(start > 1, F.lit("...")).otherwise(F.lit("")),
        F.array_join(shown, " "),
        F.when(start + size - 1 < total, F.lit("...")).otherwise(F.lit("")),
    )


def truncate_text(text: Column, limit: int = PAYLOAD_CHARS) -> Column:
    compact = normalize_ws(text)
    cut = F.concat(F.rtrim(F.substring(compact, 1, limit)), F.lit("... [truncated]"))
    return F.when(F.length(compact) <= limit, compact).otherwise(cut)


def ordered_distinct(values: Column) -> Column:
    """First-seen distinct, trimmed, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))


def summary_norm(text: Column) -> Column:
    cleaned = F.lower(normalize_ws(text))
    return F.trim(F.regexp_replace(cleaned, r"[^a-z0-9'\x{4e00}-\x{9fff}]+", " "))


def summary_tokens(text: Column) -> Column:
    """Content words plus CJK character pairs (the single character if alone)."""
    return summary_words(summary_norm(text))


def summary_words(normalized: Column) -> Column:
    """The tokens of a summary in its comparison form (``summary_norm``)."""
    latin = F.regexp_extract_all(normalized, F.lit("([a-z0-9]+(?:'[a-z0-9]+)?)"), F.lit(1))
    latin = F.filter(latin, lambda token: ~token.isin(*STOPWORDS))
    cjk = F.regexp_extract_all(normalized, F.lit(r"([\x{4e00}-\x{9fff}])"), F.lit(1))
    rest = F.greatest(F.size(cjk) - 1, F.lit(0))
    # Characters and those after them, side by side: no look-up into the text for each pair.
    pairs = F.when(
        rest > 0, F.zip_with(F.slice(cjk, F.lit(1), rest), F.slice(cjk, F.lit(2), rest), lambda a, b: F.concat(a, b))
    ).otherwise(cjk)
    return F.concat(latin, pairs)


def jaccard(left: Column, right: Column) -> Column:
    """Set ratio; 0 when either side is empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / union)


@F.pandas_udf(T.StringType())
def compat_fold(texts: pd.Series) -> pd.Series:
    """Compatibility normalization and full case folding (no JVM equivalent)."""
    return texts.map(
        lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold()
    )


def evidence_norm(text: Column) -> Column:
    """Comparison form of a quote. Only non-ASCII rows visit the Python worker."""
    odd = text.rlike(r"[^\x00-\x7F]")
    folded = F.coalesce(compat_fold(F.when(odd, text)), F.lower(text))
    folded = F.replace(folded, F.lit("­"), F.lit(""))
    return normalize_ws(F.translate(folded, DASHES, "-" * len(DASHES)))


def evidence_tokens(normalized: Column) -> Column:
    found = F.regexp_extract_all(normalized, F.lit("([a-z0-9]+(?:'[a-z0-9]+)?)"), F.lit(1))
    return F.filter(found, lambda token: ~token.isin(*STOPWORDS))


def canonical_json(payload: Column) -> Column:
    """Compact JSON of a struct whose fields are already alphabetical."""
    return F.to_json(payload, {"ignoreNullFields": "false"})


def storage_id(run_id: Column, source_id: Column) -> Column:
    return F.concat_ws(":", run_id, source_id)
