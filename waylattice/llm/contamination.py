"""Test passages inside a training corpus, by winnowed fingerprints and extension of their hits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Characters of a fingerprint and fingerprints of a window: any shared span of GRAM + WINDOW - 1 = 23 letters is found.
GRAM, WINDOW = 16, 8
#: Words of a leaked passage, and the share of them that may be changed, added or dropped ("about one in seven").
LEAST_WORDS, EDIT_SHARE = 17, 0.16
#: After a difference, extension resumes at one of the next words of the passage, within so many letters of the text.
SKIP_WORDS, SKIP_LETTERS, ANCHOR = 4, 48, 8
#: Formula: a span of at least so many letters whose fingerprints stand in more than this share of the distinct texts, and in more than so many, each time in other surroundings.
FORMULA_LETTERS, FORMULA_SHARE, FORMULA_DOCS = 30, 0.02, 40
#: A span of so many words is no formula, however many texts have it: it is a passage that is often quoted.
FORMULA_WORDS = 2 * LEAST_WORDS
#: Letters on either side of a run of known fingerprints that are its surroundings, and the widest gap inside a run.
AROUND, RUN_GAP = 160, 64
#: Test texts up to this many letters in all are broadcast; beyond it fingerprints of both sides are joined by shuffle.
BROADCAST_LETTERS = 8_000_000
#: Letters that are fingerprinted at once.
BLOCK_LETTERS = 1_000_000

_REMARK = re.compile(r"\([^()]{0,300}\)|\[[^\[\]]{0,300}\]")
_ASIDE = re.compile(r"(?:(?<=\s)|^)(--|–|—|-)\s[^–—]{1,100}?\s\1(?=\s|$)")
_NOT_WORD = re.compile(r"[\W_]+")
_ASCII = bytes(range(256)).lower()
_DROP = bytes(i for i in range(128) if not chr(i).isalnum())
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def letters(text: str | None) -> bytes:
    """The letters and digits of a text, in lower case and plain form, without remarks in brackets or dashes."""
    if not text:
        return b""
    if "(" in text or "[" in text:
        text = _REMARK.sub(" ", text)
    if "-" in text or "–" in text or "—" in text:
        text = _ASIDE.sub(" ", text)
    if text.isascii():
        return text.encode().translate(_ASCII, _DROP)
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return _NOT_WORD.sub("", text).encode("utf-8", "replace")


def word_ends(text: str) -> np.ndarray:
    """Ends of a text's words, counted in its ``letters``."""
    text = _ASIDE.sub(" ", _REMARK.sub(" ", text or ""))
    return np.cumsum([n for n in (len(letters(w)) for w in text.split()) if n], dtype=np.int64)


def hashes(block: np.ndarray) -> np.ndarray:
    """64-bit hash of every GRAM letters of a block of bytes."""
    h, base, width = block.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            base, width = base * base, width * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def winnow(block: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of texts that lie end to end in a block.

    Of every WINDOW hashes in a row the least is kept; hashes that span two texts never are.
    """
    if len(block) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = hashes(block)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    cross = (ends[:-1, None] - np.arange(1, GRAM)).ravel()
    h[cross[(cross >= 0) & (cross < len(h))]] = top
    pad = np.full(WINDOW - 1, top)
    low, width = np.concatenate([pad, h, pad]), 1
    while width < WINDOW:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    width = 1
    while width < WINDOW:  # the greatest of the minima of all windows over a position
        low, width = np.maximum(low[:-width], low[width:]), width * 2
    at = np.flatnonzero((low == h) & (h != top))
    return at, h[at]


def _common(a: bytes, i: int, b: bytes, j: int) -> int:
    """Number of equal letters from a[i] and b[j] on."""
    n, step = 0, 32
    while a[i + n : i + n + step] == b[j + n : j + n + step]:
        if i + n + step >= len(a) or j + n + step >= len(b):
            return min(len(a) - i, len(b) - j)
        n += step
    for x, y in zip(a[i + n : i + n + step], b[j + n : j + n + step]):
        if x != y:
            break
        n += 1
    return n


def _extend(item: bytes, starts: list[int], text: bytes, i: int, j: int) -> list[tuple[int, int]]:
    """Matched spans of the item to the right of a hit, across single changed, added or dropped words."""
    spans, word, n_words = [], 0, len(starts)
    while True:
        n = _common(item, i, text, j)
        if n:
            spans.append((i, i + n))
        i, j = i + n, j + n
        if i >= len(item) or j >= len(text):
            return spans
        # the word that differs began at or before i; what was read of it on the other side is taken back
        lo, hi = word, n_words
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if starts[mid] <= i else (lo, mid)
        word = lo - 1
        back = i - starts[word]
        best = None
        for skip in range(SKIP_WORDS + 1):
            if word + skip >= n_words:
                break
            at = starts[word + skip]
            anchor = item[at : at + ANCHOR]
            if len(anchor) < 4:
                break
            found = text.find(anchor, max(0, j - back), j + SKIP_LETTERS)
            if found >= 0 and (at > i or found > j or (at, found) != (i, j)) and not (at <= i and found <= j):
                best = (at, found)
                break
        if best is None:
            return spans
        i, j = best


def _least_letters(size: np.ndarray) -> int:
    """Fewest letters that enough words of a passage can have: those of some LEAST_WORDS words without the longest that may be missing."""
    if len(size) < LEAST_WORDS:
        return int(size.sum()) + 1
    run = np.sort(np.lib.stride_tricks.sliding_window_view(size, LEAST_WORDS), axis=1)
    return int(run[:, : LEAST_WORDS - int(LEAST_WORDS * EDIT_SHARE)].sum(axis=1).min())


class Index:
    """Fingerprints and texts of the test items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = [i for i, _ in items]
        self.text = [letters(t) for _, t in items]
        self.ends = [word_ends(t) for _, t in items]
        self.starts = [[0, *e[:-1].tolist()] for e in self.ends]
        self.least = [_least_letters(np.diff(e, prepend=0)) for e in self.ends]
        self.back = [t[::-1] for t in self.text]
        self.back_starts = [(len(t) - e[::-1]).tolist() for t, e in zip(self.text, self.ends)]
        fp = [winnow(np.frombuffer(t, np.uint8), np.array([len(t)])) for t in self.text]
        item = np.repeat(np.arange(len(items)), [len(p) for p, _ in fp])
        place, h = (np.concatenate([x[i] for x in fp]) if fp else np.empty(0, t) for i, t in ((0, np.int64), (1, np.uint64)))
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        # a bitmap of the hashes' first bits, sparse enough to turn most others away
        self.shift = np.uint64(64 - min(22, max(10, int(64 * len(self.hash)).bit_length())))
        self.seen = np.zeros(1 << int(64 - self.shift), bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True


def passage(hit: np.ndarray, counted: np.ndarray) -> bool:
    """Whether LEAST_WORDS words in a row of those counted are there, but for the share of EDIT_SHARE."""
    hit = hit & counted
    if hit.sum() < LEAST_WORDS * (1 - EDIT_SHARE):
        return False
    if len(hit) < LEAST_WORDS:
        return False
    # a formula in between ends a passage; its first and last word are found ones
    score = np.concatenate([[0.0], np.cumsum(np.where(counted, np.where(hit, EDIT_SHARE, EDIT_SHARE - 1.0), -1e6))])
    start = np.where(hit, score[:-1], np.inf)
    end = np.where(hit, score[1:], -np.inf)
    best = np.maximum.accumulate(end[::-1])[::-1]  # best end at or after each word
    return bool((best[LEAST_WORDS - 1 :] - start[: len(start) - LEAST_WORDS + 1] >= -1e-9).any())


def _alignments(index: Index, item: int, text: bytes, hits: list[tuple[int, int]]) -> list[np.ndarray]:
    """The words of an item that a text holds in place, for each way in which the hits (positions in text and item) extend.

    Hits in one stretch of equal letters extend alike, so one of them is extended;
    every other hit may lead to another quotation of the item and is followed.
    """
    source, n = index.text[item], len(index.text[item])
    ends = index.ends[item]
    begin = np.concatenate([[0], ends[:-1]])
    found: dict[bytes, np.ndarray] = {}
    done: dict[int, list[tuple[int, int]]] = {}
    flipped = text[::-1]
    for j, i in hits:
        if any(a <= i < b for a, b in done.get(j - i, ())):
            continue
        right = _extend(source, index.starts[item], text, i, j)
        left = [(n - b, n - a) for a, b in _extend(index.back[item], index.back_starts[item], flipped, n - i, len(text) - j)]
        # the stretch of equal letters around the hit
        stretch = (left[0][0] if left and left[0][1] == i else i, right[0][1] if right and right[0][0] == i else i + 1)
        done.setdefault(j - i, []).append(stretch)
        spans = right + left
        if sum(b - a for a, b in spans) < index.least[item]:
            continue
        there = np.zeros(n + 1, np.int32)
        for a, b in spans:
            there[a] += 1
            there[b] -= 1
        whole = np.concatenate([[0], np.cumsum(np.cumsum(there[:n]) > 0)])
        hit = whole[ends] - whole[begin] == ends - begin
        found.setdefault(hit.tobytes(), hit)
    return list(found.values())


#: Rows of a scan: a document, the number of an item, its words found in one alignment and the places of the fingerprints shared; or a fingerprint and its surroundings.
PAIRS = pa.schema([("doc", pa.int64()), ("at", pa.int32()), ("words", pa.string()), ("places", pa.list_(pa.int32())), ("gram", pa.int64()), ("around", pa.int64())])
PAIRS_DDL = "doc BIGINT, at INT, words STRING, places ARRAY<INT>, gram BIGINT, around BIGINT"


def _digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def surroundings(doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For known fingerprints, in order, at these places of these texts: a hash of the letters around the run they belong to.

    Copies and reissues of a text have the same, so that a passage in them counts once.
    """
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(at) > RUN_GAP)]))
    stop = np.append(begin[1:], len(at))
    out = np.empty(len(at), np.int64)
    for a, b in zip(begin.tolist(), stop.tolist()):
        t, first, last = texts[doc[a]], int(at[a]), int(at[b - 1]) + GRAM
        out[a:b] = _digest(t[max(0, first - AROUND) : first] + b" " + t[last : last + AROUND])
    return out


def _scan(index: Index, docs: list[tuple[int, bytes]], met: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[int, int, str, list[int]]]:
    """Pairs of a block of documents and items (numbers), with the words found in each alignment; adds each document's fingerprints and their surroundings to ``met``."""
    size = np.array([len(t) for _, t in docs], np.int64)
    ends = np.cumsum(size)
    at, h = winnow(np.frombuffer(b"".join(t for _, t in docs), np.uint8), ends)
    maybe = index.seen[(h >> index.shift).astype(np.int64)]
    at, h = at[maybe], h[maybe]
    k = np.searchsorted(index.hash, h)
    k[k == len(index.hash)] = 0
    same = index.hash[k] == h if len(index.hash) else np.zeros(len(h), bool)
    at, k = at[same], k[same]
    if not len(at):
        return
    doc = np.searchsorted(ends, at, side="right")
    if met is not None:
        once = np.unique(doc * len(index.hash) + k, return_index=True)[1]  # a document counts once
        met.append((k[once], surroundings(doc, at - (ends - size)[doc], [t for _, t in docs])[once]))
    # every place of the fingerprint in the items
    n = index.count[k]
    which = np.repeat(np.arange(len(k)), n)
    entry = np.repeat(index.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    doc, there, item, place = doc[which], (at - (ends - size)[doc])[which], index.item[entry], index.place[entry]
    pair = doc * len(index.ids) + item
    order = np.lexsort((place, there, pair))
    pair, there, place = pair[order], there[order], place[order]
    begin = np.flatnonzero(np.diff(np.concatenate([[-1], pair])))
    stop = np.append(begin[1:], len(pair))
    # a passage has more than one fingerprint, and they don't all overlap
    spread = np.maximum.reduceat(place, begin) - np.minimum.reduceat(place, begin)
    for a, b in zip(*(x[(stop - begin >= 2) & (spread >= GRAM // 2)].tolist() for x in (begin, stop))):
        d, i = divmod(int(pair[a]), len(index.ids))
        places = None
        for hit in _alignments(index, i, docs[d][1], list(zip(there[a:b].tolist(), place[a:b].tolist()))):
            if passage(hit, np.ones(len(hit), bool)):
                places = np.unique(place[a:b]).tolist() if places is None else places
                yield docs[d][0], i, "".join("1" if x else "0" for x in hit), places


def _found(out: list[tuple[int, int, str, list[int]]], gram: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
    """Pairs, and below them fingerprints with surroundings."""
    n, m = len(out), len(gram)
    return pa.record_batch([
        *[pa.array([x[k] for x in out] + [None] * m, PAIRS[k].type) for k in range(4)],
        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(gram, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(around, pa.int64())]),
    ], schema=PAIRS)


def _scanner(items: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            block, held, out, met, seen = [], 0, [], [], set()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = letters(text)
                seen.add(_digest(t))
                if not t:
                    continue
                block.append((doc, t))
                held += len(t)
                if held >= BLOCK_LETTERS:
                    out.extend(_scan(index, block, met))
                    block, held = [], 0
            if block:
                out.extend(_scan(index, block, met))
            # the texts themselves stand under gram -1
            texts = np.fromiter(seen, np.int64, len(seen))
            gram, around = (np.concatenate([x, *[m[i] for m in met]]) for i, x in ((0, np.full(len(texts), -1, np.int64)), (1, texts)))
            yield _found(out, gram, around)

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_letters: int = BROADCAST_LETTERS) -> DataFrame:
    """Documents that contain at least LEAST_WORDS consecutive words of a test item.

    Texts are compared by their letters and digits alone, so case, punctuation,
    layout, word breaks and Unicode forms don't matter; remarks in brackets or
    between dashes are taken out first. Both sides are winnowed; equal
    fingerprints are extended over single changed, added or dropped words, and
    the words found are counted. Spans under FORMULA_WORDS words whose fingerprints
    stand in more than FORMULA_SHARE of the distinct texts, each time in other
    surroundings, are formulas and don't count; copies of a text count once.

    Every alignment of an item in a document is judged on its own, so a quotation
    is found however many looser ones stand beside it. Each (document, item) comes
    out once, with ``words`` of one of its passages: 1 found, 0 not. Null ids and
    null or empty texts take no part; a document id that occurs twice counts as one
    document if either text holds the passage. Items with equal id are judged text
    by text; either may be found. Empty tables give none. Extra columns are ignored.

    Test sets of more than ``broadcast_letters`` letters take another way with the
    same result: fingerprints of both sides meet in a shuffle.

    Returns (doc, item, words).
    """
    corpus = documents.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    tests = items.where(F.col(item).isNotNull() & (F.length(item_text) > 0)).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    if (tests.agg(F.sum(F.length("text"))).first()[0] or 0) > broadcast_letters:
        return _leaked_by_shuffle(corpus, tests)
    held = sorted((r["item"], r["text"]) for r in tests.collect())  # bounded by broadcast_letters
    shared = documents.sparkSession.sparkContext.broadcast(held)
    found = cut(corpus.mapInArrow(lambda batches: _scanner(shared.value)(batches), PAIRS_DDL))
    total = found.where("gram = -1").select("around").distinct().count()
    index = Index(held)
    # fingerprints of test items only: as many as the broadcast texts have
    often = {r["gram"] for r in _frequent(found.where("gram >= 0"), total).collect()}
    pairs = found.where("doc IS NOT NULL").select("doc", "at", "words", "places")
    named = pairs.withColumn("item", _counted_item(index.ids, formulas(index, often))("at", "words", "places"))
    return named.where("item IS NOT NULL").groupBy("doc", "item").agg(F.max("words").alias("words"))


def _frequent(met: DataFrame, total: int) -> DataFrame:
    """Fingerprints in more surroundings than a passage has, from (gram, around) rows and the number of distinct texts."""
    return met.select("gram", "around").distinct().groupBy("gram").agg(F.count("*").alias("places")).where(F.col("places") > max(FORMULA_SHARE * total, FORMULA_DOCS)).select("gram")


def formulas(index: Index, often: set[int]) -> dict[int, tuple[list[tuple[int, int]], str]]:
    """By item number the spans of its letters that are formulas, and a string with x at its words in them.

    ``often``: the fingerprints (numbers in the index) that are frequent in the corpus.
    """
    if not often:
        return {}
    entry = np.flatnonzero(np.isin(np.repeat(np.arange(len(index.hash)), index.count), np.fromiter(often, np.int64, len(often))))
    entry = entry[np.lexsort((index.place[entry], index.item[entry]))]
    out = {}
    for mine in np.split(entry, np.flatnonzero(np.diff(index.item[entry])) + 1) if len(entry) else []:
        item, place = int(index.item[mine[0]]), index.place[mine]
        ends, spans = index.ends[item], []
        # neighbouring fingerprints join to spans
        for part in np.split(place, np.flatnonzero(np.diff(place) > WINDOW) + 1):
            a, b = int(part[0]), int(part[-1]) + GRAM
            if b - a >= FORMULA_LETTERS and ((ends > a) & (ends <= b)).sum() < FORMULA_WORDS:
                spans.append((a, b))
        if spans:
            mask = np.zeros(len(index.text[item]), bool)
            for a, b in spans:
                mask[a:b] = True
            total = np.concatenate([[0], np.cumsum(mask)])
            begin = np.concatenate([[0], ends[:-1]])
            out[item] = spans, "".join("x" if c else "." for c in (total[ends] - total[begin]) * 2 > ends - begin)
    return out


def _free(place: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which fingerprints at these places of an item do not lie within its formulas."""
    free = np.ones(len(place), bool)
    for a, b in spans:
        free &= (place < a) | (place + GRAM > b)
    return free


def _counts(words: str, places: np.ndarray, formula: tuple[list[tuple[int, int]], str] | None) -> bool:
    """Whether an alignment is a passage outside of formulas; some fingerprint that it shares must lie outside of them, too."""
    spans, mask = formula or ([], "")
    counted = np.array([x != "x" for x in mask.ljust(len(words), ".")], bool)
    return bool(_free(places, spans).any()) and passage(np.array([x == "1" for x in words], bool), counted)


def _counted_item(ids: list[str], formula: dict[int, tuple[list[tuple[int, int]], str]]):
    @F.pandas_udf("string")
    def item(at: pd.Series, words: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([ids[i] if _counts(w, np.asarray(p), formula.get(i)) else None for i, w, p in zip(at, words, places)], dtype=object)

    return item


def fingerprints(texts: DataFrame) -> DataFrame:
    """(id, text) to the distinct fingerprints (id, gram) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(winnow(np.frombuffer(t, np.uint8), np.array([len(t)]))[1]).astype(np.int64) for t in map(letters, batch.column(1).to_pylist())]
            row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(np.concatenate([np.empty(0, np.int64), *grams]))], names=["id", "gram"])

    return texts.mapInArrow(run, f"id {texts.schema[0].dataType.simpleString()}, gram BIGINT")


def _frequent_by_shuffle(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """The fingerprints that ``_frequent`` finds, from (doc, text) and (doc, gram) rows of known fingerprints."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([_digest(letters(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["around"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, grams in zip(*(c.to_pylist() for c in batch.columns)):
                t = letters(text)
                at, h = winnow(np.frombuffer(t, np.uint8), np.array([len(t)]))
                known = np.isin(h.astype(np.int64), np.array(grams, np.int64))
                gram, once = np.unique(h[known].astype(np.int64), return_index=True)
                if len(gram):
                    yield pa.record_batch([pa.array(gram), pa.array(surroundings(np.zeros(known.sum(), np.int64), at[known], [t])[once])], names=["gram", "around"])

    total = corpus.select("text").mapInArrow(digests, "around BIGINT").distinct().count()
    # a fingerprint in few documents has few surroundings
    many = hits.groupBy("gram").agg(F.count("*").alias("docs")).where(F.col("docs") > max(FORMULA_SHARE * total, FORMULA_DOCS)).select("gram")
    of_doc = hits.join(hits.join(many, "gram", "left_semi").select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.collect_set("gram").alias("grams"))
    met = corpus.join(of_doc, "doc").select("text", "grams").mapInArrow(places, "gram BIGINT, around BIGINT")
    return _frequent(met.join(many, "gram", "left_semi"), total)


#: Items whose indexes a worker keeps at hand.
KEPT_INDEXES = 1024


def _leaked_by_shuffle(corpus: DataFrame, tests: DataFrame) -> DataFrame:
    """The same for test sets of any size: fingerprints of both sides meet in a shuffle, then the texts of each candidate pair.

    All fingerprints of an item but those in its formulas propose pairs, which need
    two places of the item before any text moves. A fingerprint that
    is frequent without being part of a formula has as many partners as it has
    documents (adaptive execution splits such a key: its other side is few items).
    """
    mine = cut(fingerprints(corpus.select("doc", "text")).withColumnRenamed("id", "doc"))
    keyed = cut(tests.withColumn("key", F.sha2(F.concat_ws("\x00", "item", "text"), 256)))
    theirs = cut(fingerprints(keyed.select("key", "text")).withColumnRenamed("id", "key"))
    hits = cut(mine.join(theirs.select("gram").distinct(), "gram", "left_semi"))
    frequent = cut(_frequent_by_shuffle(corpus, hits))
    often = cut(theirs.join(frequent, "gram").groupBy("key").agg(F.collect_set("gram").alias("often")))

    def formula(index: Index, grams: list[int] | None) -> tuple[list[tuple[int, int]], str] | None:
        return formulas(index, set(np.flatnonzero(np.isin(index.hash, np.array(grams or [], np.int64).astype(np.uint64))).tolist())).get(0)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, grams in zip(*(c.to_pylist() for c in batch.columns)):
                index = Index([(key, text)])
                free = _free(index.place, (formula(index, grams) or ([], ""))[0])
                gram, places = np.unique(np.repeat(index.hash, index.count)[free].astype(np.int64), return_counts=True)
                yield pa.record_batch([pa.array([key] * len(gram), pa.string()), pa.array(gram), pa.array(places, pa.int64()), pa.array([not free.all()] * len(gram), pa.bool_())], names=["key", "gram", "places", "mixed"])

    proposing = keyed.join(often, "key", "left").select("key", "text", "often").mapInArrow(propose, "key STRING, gram BIGINT, places BIGINT, mixed BOOLEAN")
    # a pair needs two places of the item; where it has formulas, one of them may be in these
    shared = proposing.join(hits.distinct(), "gram").groupBy("doc", "key").agg(F.sum("places").alias("places"), F.max("mixed").alias("mixed"))
    pairs = shared.where("places >= 2 OR mixed").select("doc", "key")
    both = pairs.join(keyed.withColumnRenamed("text", "item_text"), "key").join(often, "key", "left").join(corpus, "doc")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[Index, tuple[list[tuple[int, int]], str] | None]] = {}
        for batch in batches:
            out = []
            for doc, text, key, item, item_text, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if key not in kept:
                    if len(kept) >= KEPT_INDEXES:
                        kept.pop(next(iter(kept)))
                    index = Index([(item, item_text)])
                    kept[key] = index, formula(index, grams)
                index, spans = kept[key]
                out.extend((d, item, w) for d, _, w, p in _scan(index, [(doc, letters(text))]) if _counts(w, np.array(p), spans))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], names=["doc", "item", "words"])

    checked = both.select("doc", "text", "key", "item", "item_text", "often").mapInArrow(check, "doc BIGINT, item STRING, words STRING")
    return checked.groupBy("doc", "item").agg(F.max("words").alias("words"))
