"""Entities and typed relations from chunk text by patterns."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import lexicons as L

ENTITY = "struct<entity_id:string,name:string,entity_type:string,confidence:float,mentions:array<struct<chunk_id:string,start_offset:int,end_offset:int,confidence:float>>>"
RELATION = "struct<source:string,target:string,relation_type:string,confidence:float,context:array<string>>"
SCHEMA = f"chunk_ord long, chunk_id string, entities array<{ENTITY}>, relationships array<{RELATION}>"
ROWS = 1000
"""What is found in so many chunks leaves a worker at once."""
_EDGE = ".,;:!?\"'()"


def identity(kind: str, name: str) -> str:
    key = "".join(c if c.isalpha() or c.isnumeric() else "_" for c in name.lower())
    return f"{kind.lower()}_" + re.sub("_+", "_", key).strip("_")


_SPACE = re.compile(r"\s")
_MAY_BE_CAPITAL = re.compile(r"[A-Z]|[^\x00-\x7f]")
_MAY_END = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029!?.]")


def _word_end(text: str, i: int) -> int:
    space = _SPACE.search(text, i)
    return space.start() if space else max(i, len(text))


def _skip(text: str, i: int, what: str) -> int:
    while i < len(text) and text[i] in what:
        i += 1
    return i


def _joins_ending(text: str, i: int) -> bool:
    """Whether an organisation ending is the next word."""
    at = _skip(text, i, " \t")
    end = at
    while end < len(text) and text[end].isalpha():
        end += 1
    word = text[at:end].lower()
    return bool(word) and (word in L.ORGANISATION_ENDINGS or word + "." in L.ORGANISATION_ENDINGS)


def _ends_run(text: str, start: int, end: int) -> bool:
    """Whether the punctuation behind a word parts it from what follows."""
    mark = text[end - 1]
    if mark in ",;:":
        return not (mark == "," and _joins_ending(text, end))
    if mark in ".!?":
        return text[start:end].split()[-1].strip(".!?").lower() not in L.TITLES
    return False


def _next_word(text: str, end: int) -> int | None:
    """Where the run goes on behind the word that ends at `end`; None if it doesn't."""
    at = _skip(text, end, " ")
    if at >= len(text) or at != end + 1:
        return None
    if text[at].isupper():
        return at
    if text[at].islower():
        stop = _word_end(text, at)
        after = _skip(text, stop, " ")
        if text[at:stop].lower() in ("of", "the") and after < len(text) and text[after].isupper():
            return after
    return None


def capital_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each run of capitalised words, punctuation at its ends left out, two characters at least."""
    out, i = [], 0
    while True:
        capital = _MAY_BE_CAPITAL.search(text, i)
        if capital is None:
            break
        i = capital.start()
        if not (text[i].isupper() and (i == 0 or text[i - 1].isspace() or text[i - 1] in "\"'([{")):
            i += 1
            continue
        start, word = i, i
        while True:
            i = _word_end(text, word)
            following = None if _ends_run(text, start, i) else _next_word(text, i)
            if following is None:
                break
            word = following
        a, b = start, i
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b - a >= 2:
            out.append((a, b))
    return out


def classify(name: str) -> tuple[str, float] | None:
    """Type and confidence of a run, or None if it names nothing."""
    words = [w for w in name.split(" ") if w]
    if len(words) > 1 and words[0].lower() in ("the", "a", "an"):
        words = words[1:]
    if not words or (len(words) == 1 and words[0].lower() in L.NOT_ENTITIES):
        return None
    whole = " ".join(words).lower()
    if words[-1].lower() in L.ORGANISATION_ENDINGS or whole.startswith(L.ORGANISATION_BEGINNINGS):
        return "ORGANIZATION", 0.9
    if whole in L.PLACES:
        return "LOCATION", 0.9
    if words[0].strip(".").lower() in L.TITLES:
        return "PERSON", 0.9
    if len(words) > 1:
        return "PERSON", 0.8
    return ("CONCEPT", 0.6) if len(words[0]) >= 3 else None


def classify_column(name: Column) -> Column:
    """classify() inside the JVM: struct<entity_type, confidence>, null where it is None."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    article = (F.size(words) > 1) & F.lower(F.element_at(words, 1)).isin("the", "a", "an")
    words = F.when(article, F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    whole, n = F.lower(F.array_join(words, " ")), F.size(words)
    first, last = F.lower(F.get(words, F.lit(0))), F.lower(F.get(words, n - 1))
    starts = F.lit(False)
    for x in L.ORGANISATION_BEGINNINGS:
        starts = starts | F.startswith(whole, F.lit(x))

    def kind(t: str, c: float) -> Column:
        return F.struct(F.lit(t).alias("entity_type"), F.lit(c).alias("confidence"))

    return (
        F.when((n == 0) | ((n == 1) & first.isin(*L.NOT_ENTITIES)), F.lit(None))
        .when(last.isin(*L.ORGANISATION_ENDINGS) | starts, kind("ORGANIZATION", 0.9))
        .when(whole.isin(*L.PLACES), kind("LOCATION", 0.9))
        .when(F.regexp_replace(first, r"^\.+|\.+$", "").isin(*L.TITLES), kind("PERSON", 0.9))
        .when(n > 1, kind("PERSON", 0.8))
        .when(F.char_length(F.element_at(words, 1)) >= 3, kind("CONCEPT", 0.6))
    )


def _sentence_ends(text: str) -> list[int]:
    """Where the sentences end; the number of ends ahead of an offset is the number of its sentence."""
    return [m.start() for m in _MAY_END.finditer(text) if m.group() != "." or _period_ends(text, m.start())]


def _period_ends(text: str, i: int) -> bool:
    start = i
    while start > 0 and text[start - 1].isalpha():
        start -= 1
    word = text[start:i].lower()
    if word in L.TITLES:
        return False
    if word in L.ABBREVIATIONS:
        after = _skip(text, i + 1, " \t")
        return after >= len(text) or text[after] in "\n\r" or text[after].isupper()
    return True


_CUES = {
    ("ORGANIZATION", "PERSON"): ([("WORKS_FOR", ("works for", "employed by")), ("LEADS", ("founded", "ceo"))], "ASSOCIATED_WITH"),
    ("LOCATION", "PERSON"): ([("BORN_IN", ("born in", " from ")), ("LOCATED_IN", ("lives in", "based in"))], "ASSOCIATED_WITH"),
    ("LOCATION", "ORGANIZATION"): ([("HEADQUARTERED_IN", ("headquartered", "based in"))], "LOCATED_IN"),
    ("PERSON", "PERSON"): ([("MARRIED_TO", ("married", "spouse")), ("COLLEAGUE_OF", ("colleague", "partner"))], "KNOWS"),
}
_TARGETS = {"WORKS_FOR": "ORGANIZATION", "LEADS": "ORGANIZATION", "BORN_IN": "LOCATION", "HEADQUARTERED_IN": "LOCATION", "LOCATED_IN": "LOCATION"}


def relation_type(a: str, b: str, context: str) -> str:
    """Relation of two entity types by the first cue in the lower-case context."""
    cues, otherwise = _CUES.get(tuple(sorted((a, b))), ([], "RELATED_TO"))
    return next((t for t, words in cues if any(w in context for w in words)), otherwise)


def relation_type_column(a: Column, b: Column, context: Column) -> Column:
    out = F.lit("RELATED_TO")
    for (x, y), (cues, otherwise) in _CUES.items():
        found = F.lit(otherwise)
        for t, words in reversed(cues):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(context, F.lit(w))
            found = F.when(hit, F.lit(t)).otherwise(found)
        out = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), found).otherwise(out)
    return out


def _swapped(relation: str, a: str, b: str) -> bool:
    """Whether the second entity is the source: the place or organisation is what such a relation points to."""
    wanted = _TARGETS.get(relation)
    if wanted is None or a != wanted:
        return False
    return relation == "LOCATED_IN" or b == ("ORGANIZATION" if relation == "HEADQUARTERED_IN" else "PERSON")


def relate(entities: list[dict], text: str, chunk_id: str) -> list[dict]:
    """One edge per pair of entities that a sentence mentions together; a telling relation goes before a vague one."""
    if len(entities) < 2:
        return []
    ends = _sentence_ends(text)
    # only what one sentence mentions together is looked at
    spots: dict[int, list[tuple[int, str, str]]] = {}
    placed = []
    for e in entities:
        at = [(m["start_offset"], bisect_left(ends, m["start_offset"])) for m in e["mentions"]]
        placed.append((e, at, {s for _, s in at}))
        for offset, s in at:
            spots.setdefault(s, []).append((offset, e["entity_id"], e["entity_type"]))
    out, seen = [], set()
    for (a, at_a, in_a), (b, at_b, in_b) in combinations(placed, 2):
        if in_a.isdisjoint(in_b):
            continue
        own, kinds = {a["entity_id"], b["entity_id"]}, {a["entity_type"], b["entity_type"]}
        others = {s: [x for x in spots[s] if x[1] not in own] for s in in_a & in_b}
        chosen = None
        for (oa, sa), (ob, sb) in product(at_a, at_b):
            if sa != sb:
                continue
            lo, hi = (oa, ob) if oa <= ob else (ob, oa)
            if any(lo < at < hi and kind in kinds for at, _, kind in others[sa]):
                continue
            end = min(hi + 1, len(text))
            if not any(at > hi for at, _, _ in others[sa]):
                end = ends[sa] + 1 if sa < len(ends) else len(text)
            relation = relation_type(a["entity_type"], b["entity_type"], text[lo:end].lower())
            source, target = (b, a) if _swapped(relation, a["entity_type"], b["entity_type"]) else (a, b)
            telling = relation in L.TELLING_RELATIONS
            if chosen is None or telling:
                chosen = (source["entity_id"], target["entity_id"], relation)
            if telling:
                break
        if chosen and chosen not in seen:
            seen.add(chosen)
            out.append({"source": chosen[0], "target": chosen[1], "relation_type": chosen[2], "confidence": 0.6, "context": [chunk_id]})
    return out


def extract_text(text: str | None, chunk_id: str, min_confidence: float = 0.5) -> tuple[list[dict], list[dict]]:
    """(entities, relationships) of one chunk; entities are told apart by name, in order of first mention."""
    found: dict[str, dict] = {}
    for a, b in capital_runs(text or ""):
        name = text[a:b]
        kind = classify(name)
        if kind is None or kind[1] < min_confidence:
            continue
        e = found.setdefault(name, {"entity_id": identity(kind[0], name), "name": name, "entity_type": kind[0], "confidence": kind[1], "mentions": []})
        e["mentions"].append({"chunk_id": chunk_id, "start_offset": a, "end_offset": b, "confidence": kind[1]})
    entities = list(found.values())
    return entities, relate(entities, text or "", chunk_id)


def extract(chunks: DataFrame, min_confidence: float = 0.5, extractor=None) -> DataFrame:
    """SCHEMA of chunks(chunk_ord, chunk_id, content): one row per chunk.

    extractor(text, chunk_id) -> (entities, relationships) may take the place of
    the patterns; it must be picklable. Null texts give empty lists.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = extractor or (lambda t, c: extract_text(t, c, min_confidence))
        for rows in (batch.iloc[a : a + ROWS] for batch in batches for a in range(0, len(batch), ROWS)):
            both = [work(t if isinstance(t, str) else "", c) for t, c in zip(rows["content"], rows["chunk_id"])]
            rows = rows.reset_index(drop=True)
            yield pd.DataFrame({"chunk_ord": rows["chunk_ord"], "chunk_id": rows["chunk_id"], "entities": [x[0] for x in both], "relationships": [x[1] for x in both]})

    place = chunks.schema["chunk_ord"].dataType.simpleString()
    return chunks.select("chunk_ord", "chunk_id", "content").mapInPandas(run, SCHEMA.replace("chunk_ord long", f"chunk_ord {place}"))


def cap_entities(found: DataFrame, min_confidence: float, cap: int) -> DataFrame:
    """(chunk_ord, chunk_id, at, entity struct columns): entities that reach the confidence; per chunk the `cap` surest, all if cap <= 0."""
    rows = found.select("chunk_ord", "chunk_id", F.posexplode("entities").alias("at", "e")).select("chunk_ord", "chunk_id", "at", "e.*").where(F.col("confidence") >= F.lit(min_confidence).cast("float"))
    if cap <= 0:
        return rows
    order = Window.partitionBy("chunk_id").orderBy(F.desc("confidence"), "at")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def gate_relationships(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(chunk_ord, chunk_id, at, edge columns): edges whose two ends the same chunk kept."""
    rows = found.select("chunk_ord", "chunk_id", F.posexplode("relationships").alias("at", "r")).select("chunk_ord", "chunk_id", "at", "r.*")
    known = kept.select("chunk_id", "entity_id").distinct()
    for end in ("source", "target"):
        rows = rows.join(known.withColumnRenamed("entity_id", end), ["chunk_id", end], "left_semi")
    return rows
