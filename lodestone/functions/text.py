"""Text as Column expressions; everything but the counting of terms stays inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.lexicons import QUESTION_WORDS, STOPWORDS

WORD = r"[\p{IsAlphabetic}\p{N}][\p{IsAlphabetic}\p{N}\p{M}]*"


def _words(xs) -> Column:
    return F.array(*[F.lit(x) for x in sorted(xs)])


def trim_space(text: Column) -> Column:
    """text without Unicode white space, line breaks included, at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def index_tokens(text: Column) -> Column:
    """plain_tokens of two characters or more that are no stopwords."""
    return F.filter(plain_tokens(text), lambda t: (F.char_length(t) >= 2) & ~t.isin(*sorted(STOPWORDS)))


def _term_counts(lists: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    many = max(1, len(words))
    found, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + place[codes], return_counts=True)
    rows = pa.StructArray.from_arrays([words.take(pa.array(order[found % many])), pa.array(tf.astype(np.int64))], ["term", "tf"])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(found // many, minlength=len(size)))]).astype(np.int32), rows)


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array in order of term, counted within the row, in Arrow: no token becomes a Python object."""
    return F.arrow_udf(_term_counts, "array<struct<term:string,tf:bigint>>")(tokens)


def keyword_tokens(text: Column) -> Column:
    """Words between white space, with everything but letters, digits, '-' and '_' deleted; short ones, numbers and stopwords go."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\p{IsAlphabetic}\p{N}\p{M}_\-\s]+", "")
    words = F.regexp_extract_all(bare, F.lit(r"(?U)\S+"), F.lit(0))
    return F.filter(words, lambda t: (F.char_length(t) >= 3) & ~t.isin(*sorted(STOPWORDS)) & (((t >= "a") & (t < "{")) | ~t.rlike(r"^\p{N}+$")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def clean_text(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences with their end marks ('.', '!', '?'; line breaks end one too), trimmed, empty ones left out."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+"), F.lit(0))
    return F.filter(F.transform(pieces, trim_space), lambda s: s != "")


def entity_id(kind: Column, name: Column) -> Column:
    """Lower-case kind and normalised name, joined by '_'."""
    key = F.regexp_replace(F.lower(name), r"[^\p{IsAlphabetic}\p{N}]+", "_")
    return F.concat(F.lower(kind), F.lit("_"), F.regexp_replace(key, "^_+|_+$", ""))


def relation_label(description: Column) -> Column:
    """The letters and digits of the first three words in upper case, joined by '_'; RELATED_TO where there are none."""
    first = F.slice(F.regexp_extract_all(description, F.lit(r"(?U)\S+"), F.lit(0)), 1, 3)
    bare = F.filter(F.transform(first, lambda w: F.upper(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", ""))), lambda w: w != "")
    label = F.array_join(bare, "_")
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("RELATED_TO")).otherwise(label)


def strip_thinking(text: Column) -> Column:
    """text without <think> blocks, trimmed. A close mark ahead of every open one leaves what follows as it is."""
    stray = F.locate("</think>", text)
    opened = F.locate("<think>", text)
    cleaned = F.regexp_replace(text, r"(?s)\G((?:(?!</?think>).)*)<think>.*?</think>", "$1")
    return trim_space(F.when((stray > 0) & ((opened == 0) | (stray < opened)), text).otherwise(cleaned))


def question_keywords(question: Column, limit: int) -> Column:
    """Distinct words of a question in order of first use, in their own case, stopwords left out unless nothing else is there."""
    words = F.regexp_extract_all(question, F.lit(WORD), F.lit(0))

    def first_seen(xs: Column) -> Column:
        low = F.transform(xs, F.lower)
        return F.filter(xs, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)

    kept = first_seen(F.filter(words, lambda w: ~F.array_contains(_words(QUESTION_WORDS), F.lower(w))))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(first_seen(words)), 1, max(0, limit)) if limit > 0 else F.array().cast("array<string>")


def cap_keywords(high: Column, low: Column, limit: int) -> tuple[Column, Column]:
    """Both lists cut to `limit` in all, high first."""
    limit = max(0, limit)
    kept = F.slice(high, 1, limit) if limit else F.array().cast("array<string>")
    room = F.lit(limit) - F.size(kept)
    return kept, F.when(room > 0, F.slice(low, F.lit(1), F.greatest(room, F.lit(1)))).otherwise(F.array().cast("array<string>"))
