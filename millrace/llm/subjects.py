"""Subject areas of documents (problem 10)."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import count_tokens
from millrace.session import cut

#: Hash buckets for word n-grams; the model holds weights only for those met when it was fitted.
BUCKETS = 1 << 32
#: An n-gram in at least COMMON_PART of all documents, of which no subject is, beyond chance, the main one of more than
#: COMMON_SHARE, is common matter (headings, courtesies, keywords) and no evidence; nor is a rarer pair of words. Of few
#: documents it takes COMMON_DOCUMENTS, the least from which one subject shows beyond chance.
COMMON_PART, COMMON_DOCUMENTS, COMMON_SHARE = 0.00125, 5, 0.22
#: A word that labels an unclear unit by its section is in at least this part of all documents, and in so many of few.
KNOWN_PART, KNOWN_DOCUMENTS = 0.00075, 3
#: The weights are fitted on the examples and on the units of at most this many whole documents, drawn by a hash of the
#: id. Sentence openings and the documents of an n-gram are counted over all documents.
FIT_DOCUMENTS = 4_000
#: A sentence opening starts at least this part of the sentences it is learnt from, so there are at most 4 / OPENING_PART.
OPENING_PART = 0.00013
#: First words of sentences that a task holds before it passes their counts on.
HELD_OPENINGS = 200_000
#: A text is about a subject if at least this many of its units are.
MIN_UNITS = 2

#: Evidence and lead before the next subject from which a part is clearly about a subject; below NONE it says nothing.
EVIDENCE, LEAD, NONE = 1.0, 1.0, 0.3
#: A subject at most NEAR behind the best one in a part may still win by the logarithm of its share of the text's clear
#: parts, times CONTEXT.
NEAR, CONTEXT = 4.0, 1.5
#: Folds in which labels of examples are tried.
FOLDS = 5

_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|h[1-6]|span|b|i|em|strong|a|pre|code|td|tr|table)(?:\s[^<>]*)?/?>", re.I)
_GARBLED = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{2,}")
_CODE_LINE = re.compile(r"^\s*(?:def |class |import |from \S+ import|func |type \w+ |package |const |var |let |export |module\.|return\b|public |private |fn |struct |use |#include|for .*:$|if .*[:{]$|//|#(?!#)\s|\"\"\"|[{}\])];?$|\w+(?:\.\w+)* (?:=|:=|\+=) )|[{;]\s*$|=>|^\s+\w[\w.]*\(.*\)\s*$")
_COMMENT = re.compile(r"\"\"\"(.*?)\"\"\"|(?:^|(?<=\s))(?://+|#+)\s*([^\n]*)", re.S)
_REMARK = re.compile(r"\s*(?://|#(?!#))")
_HEADING = re.compile(r"\s*#{2,6}\s")
_SENTENCE = re.compile(r"(?<=[.?!])[\"')\]]*\s+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\w+")
#: A stretch without sentence ends that is longer than this is cut at learned sentence starts.
LONG_WORDS, SHORT_WORDS = 24, 10


def _ungarble(m: re.Match) -> str:
    run = m.group()
    for codec in ("latin-1", "cp1252"):
        try:
            return run.encode(codec).decode("utf-8")
        except UnicodeError:
            pass
    try:  # cp1252 with its five undefined bytes as control characters
        return bytes(ord(c) if ord(c) < 256 else c.encode("cp1252")[0] for c in run).decode("utf-8")
    except UnicodeError:
        return run


def readable(text: str) -> str:
    """The text without markup, entities, broken encoding, byte-order marks and odd line ends."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "").replace(" ", "\n")
    if "<" in text:
        text = _TAG.sub("", re.sub(r"(</(?:p|div|li|h[1-6])>|<br\s*/?>)(?=<)", r"\1\n", text, flags=re.I))
    if "&" in text:
        text = html.unescape(text)
    return _GARBLED.sub(_ungarble, text)


def units(text: str) -> Iterator[list[str]]:
    """The sentences, lines and code blocks of a readable text, each as its parts.

    A sentence or line is its own single part; headings are the titles of sections, not units. A code block, in a fence or between blank lines, has its code and its
    comments as parts: a comment may be about something else than the names around it.
    """
    fence: list[str] | None = None
    block: list[str] = []

    def flush() -> Iterator[list[str]]:
        if not block:
            return
        other = [x for x in block if not _REMARK.match(x)]  # remarks stand in code and before prose
        if sum(bool(_CODE_LINE.search(x)) for x in other) * 2 >= len(other):
            yield from _code(block)
        else:
            for line in block:
                if _HEADING.match(line):
                    continue
                for s in _SENTENCE.split(line):
                    if s.strip():
                        yield [s]
        block.clear()

    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            if fence is None:
                yield from flush()
                fence = []
            else:
                yield from _code(fence)
                fence = None
        elif fence is not None:
            fence.append(line)
        elif line.strip():
            block.append(line)
        else:
            yield from flush()
    if fence:
        block.extend(fence)
    yield from flush()


def _code(lines: list[str]) -> Iterator[list[str]]:
    whole = "\n".join(lines)
    if not whole.strip():
        return
    comments = [a or b for a, b in _COMMENT.findall(whole)]
    parts = [_COMMENT.sub(" ", whole), *(s for c in comments for s in _SENTENCE.split(c))]
    yield [p for p in parts if p.strip()]


def words(part: str) -> list[str]:
    """Words in lower case, joined names taken apart, without plural endings."""
    return [w.rstrip("s") or w if len(w) > 3 else w for w in _WORD.findall(_CAMEL.sub(" ", part).lower())]


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


#: Odd multipliers that mix the hashes of words into that of a pair, or of the words of an opening.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_ALL = (1 << 64) - 1


def pair(a: int, b: int) -> int:
    """The bucket of a pair of words from the words' buckets; :func:`pairs_of` does the same for arrays."""
    return ((a * MIX[0] + b * MIX[1] + 1) & _ALL) >> 32


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(MIX[0]) + b.astype(np.uint64) * np.uint64(MIX[1]) + np.uint64(1)) >> np.uint64(32)


class Hasher:
    """Buckets of word n-grams (one and two words), or lines of a model, with a memory of bounded size."""

    def __init__(self, slots: dict[int, int] | None = None) -> None:
        self.slots, self.known = slots, {}

    def one(self, word: str) -> int:
        if (k := self.known.get(word)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            k = self.known[word] = crc(word)
        return k

    def grams(self, ws: list[str]) -> list[int]:
        own = [self.one(w) for w in ws]
        own += [pair(a, b) for a, b in zip(own, own[1:])]
        return own if self.slots is None else [self.slots.get(k, 0) for k in own]


#: The kinds of opening, and the places of the words that each looks at.
OPENINGS = {"2": (0, 1), "s": (0, 2), "3": (0, 1, 2), "q": (0, 2, 3)}


def _openings(tokens: list[str]) -> tuple[tuple, ...] | None:
    """What may tell a sentence start: the first words, with and without the second."""
    if len(tokens) < 4:
        return None
    return tuple((kind, *[tokens[i] for i in places]) for kind, places in OPENINGS.items())


def _plain_token(token: str) -> str:
    return "0" if (low := token.lower()).isdigit() else low


def _tokens(sentence: str) -> list[str]:
    return [_plain_token(t) for t in _TOKEN.findall(sentence)]


#: What may stand before a sentence on its line: a mark of a list or heading, or a label.
_BEFORE = re.compile(r"\s*(?:[-*+•]\s+|[0-9]+[.)]\s+|#+\s*|\w+: )")


def _sentences(texts: Iterable[str]) -> Iterator[list[str]]:
    """The tokens of the texts' sentences of 4 to LONG_WORDS words, whose starts punctuation and lines show."""
    for text in texts:
        for parts in units(readable(text)):
            if len(parts) != 1:
                continue
            before = _BEFORE.match(parts[0])
            ts = _tokens(parts[0][before.end() :] if before else parts[0])
            if 4 <= len(ts) <= LONG_WORDS:
                yield ts


def _inside(sentences: Iterable[list[str]], wanted: frozenset) -> Iterator[tuple]:
    """The occurrences of wanted patterns after the start of a sentence."""
    firsts = {p[1] for p in wanted}
    for ts in sentences:
        for i in range(1, len(ts) - 3):
            if ts[i] in firsts:
                yield from wanted.intersection(_openings(ts[i : i + 4]))


def learn_openings(texts: Iterable[str], least: int = 4, share: float = 0.8, part: float = OPENING_PART) -> frozenset:
    """Word patterns that stand at the start of a sentence in at least ``share`` of their occurrences.

    Learnt from sentences of at most LONG_WORDS words; a pattern starts at least ``part`` of them and ``least``.
    """
    sentences = list(_sentences(texts))
    starts = Counter(p for ts in sentences for p in _openings(ts))
    often = frozenset(p for p, n in starts.items() if n >= max(least, part * len(sentences)))
    inside = Counter(_inside(sentences, often))
    return frozenset(p for p in often if starts[p] >= share * (starts[p] + inside[p]))


def openings_of(texts: DataFrame, least: int = 4, share: float = 0.8, part: float = OPENING_PART) -> frozenset:
    """:func:`learn_openings` over the one column of a table, which is parsed once for it."""
    name = texts.columns[0]
    return learned_openings(cut(parse_units(texts.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(name).alias("text")))), least, share, part)


def learned_openings(parsed: DataFrame, least: int = 4, share: float = 0.8, part: float = OPENING_PART) -> frozenset:
    """:func:`learn_openings` over parsed texts: starts were counted with the parsing, what starts often is counted inside."""
    spark = parsed.sparkSession
    t = F.split("first", " ")
    patterns = F.array(*[F.concat_ws(" ", F.lit(kind), *[t[i] for i in places]) for kind, places in OPENINGS.items()])
    firsts = parsed.filter("first IS NOT NULL")
    sentences = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    starts = firsts.select(F.explode(patterns).alias("opening"), "n").groupBy("opening").agg(F.sum("n").alias("n"))
    often = {tuple(r.opening.split(" ")): r.n for r in starts.filter(F.col("n") >= max(least, part * sentences)).collect()}  # at most 4 / part
    if not often:
        return frozenset()
    names = sorted(often)
    shared = spark.sparkContext.broadcast(pattern_hashes(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        order = np.argsort(keys, kind="stable")
        counts = np.zeros(len(keys), np.int64)
        for b in batches:
            p = Parsed(b)
            use = np.flatnonzero(p.skip >= 0)
            at, _ = _positions(p.token_start[use] + p.skip[use], p.part_tokens[use] - p.skip[use])
            for hashes in _hashes_at(p.tokens, at).values():
                place = np.searchsorted(keys[order], hashes)
                met = order[np.minimum(place, len(keys) - 1)]
                np.add.at(counts, met[keys[met] == hashes], 1)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"i": pa.array(found, pa.int32()), "n": pa.array(counts[found], pa.int64())})

    inside = {r.i: r.n for r in parsed.filter("words IS NOT NULL").select(*PARSED).mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    return frozenset(p for i, p in enumerate(names) if often[p] >= share * (often[p] + inside.get(i, 0)))


def cut_long(sentence: str, openings: frozenset) -> list[str]:
    """A stretch of several sentences without sentence ends, cut where a learned opening begins.

    A stretch of up to LONG_WORDS words that ends like a sentence, or of up to SHORT_WORDS, is left as it is.
    """
    found = list(_TOKEN.finditer(sentence))
    if len(found) <= SHORT_WORDS or not openings or len(found) <= LONG_WORDS and sentence.rstrip()[-1:] in ".?!":
        return [sentence]
    low = [_plain_token(m.group()) for m in found]
    cuts, last = [0], 0
    for i in range(1, len(low) - 3):
        if i - last >= 4 and any(o in openings for o in _openings(low[i : i + 4])):
            cuts.append(found[i].start())
            last = i
    return [sentence[a:b] for a, b in zip(cuts, [*cuts[1:], len(sentence)])]


def text_units(text: str, openings: frozenset) -> Iterator[list[list[str]]]:
    """The units of a raw text, each as the word lists of its parts."""
    for parts in units(readable(text)):
        for piece in cut_long(parts[0], openings) if len(parts) == 1 else (None,):
            lists = [words(p) for p in (parts if piece is None else [piece])]
            if lists := [x for x in lists if x]:
                yield lists


#: Columns of a parsed text: hashes of its words, in parts; of each part the number of words, whether it starts a unit,
#: and, where it is a unit of its own, its tokens, the words of each, whether it may be cut, and the tokens before its
#: sentence (-1: not one to learn openings from).
PARSED = ("words", "part_words", "unit", "tokens", "token_words", "part_tokens", "long", "skip")
_ARRAYS = ", ".join(f"{c} array<int>" for c in PARSED)


class _Numbers(dict):
    """Numbers tokens in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Parser:
    """Batches of texts as arrays of numbers. What a token gives is kept, so that a common token is taken apart once."""

    def __init__(self) -> None:
        self._forget()
        self.firsts: Counter = Counter()

    def _forget(self) -> None:
        self.known, self.plain = _Numbers(), []
        self.hash, self.words_of = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.words, self.word_at = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Take apart the tokens that are new."""
        new = list(self.known)[len(self.plain) :]
        if not new:
            return
        own = [[crc(w) for w in words(t)] for t in new]
        plain = [_plain_token(t) for t in new]
        n = np.array([len(o) for o in own], np.int64)
        self.word_at = np.r_[self.word_at, len(self.words) + _starts(n)]
        self.words_of = np.r_[self.words_of, n]
        self.words = np.r_[self.words, np.array([w for o in own for w in o], np.uint32)]
        self.hash = np.r_[self.hash, np.array([crc(t) for t in plain], np.uint32)]
        self.plain += plain

    def parse(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The columns PARSED of texts, empty for null ones; first words of their sentences are counted in ``firsts``."""
        if len(self.known) > 300_000:
            self._forget()
        number = self.known.__getitem__
        ids: list[int] = []
        sizes: list[int] = []
        unit: list[int] = []
        single: list[int] = []
        long: list[int] = []
        skip: list[int] = []
        parts_of: list[int] = []
        firsts: list[int] = []
        for text in texts:
            held = len(sizes)
            for parts in units(readable(text)) if text else ():
                alone = len(parts) == 1
                new = 1
                for part in parts:
                    raw = _TOKEN.findall(part)
                    n = len(raw)
                    k = -1
                    cut_ = 0
                    if alone:
                        before = _BEFORE.match(part)
                        k = len(_TOKEN.findall(before.group())) if before else 0
                        if 4 <= n - k <= LONG_WORDS:
                            firsts.append(len(ids) + k)
                        else:
                            k = -1
                        cut_ = int(n > SHORT_WORDS and not (n <= LONG_WORDS and part.rstrip()[-1:] in ".?!"))
                    ids.extend(map(number, raw))
                    sizes.append(n), unit.append(new), single.append(alone), skip.append(k), long.append(cut_)
                    new = 0
            parts_of.append(len(sizes) - held)
        self._learn()
        flat, size, alone = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(single, bool)
        plain = self.plain
        self.firsts.update(" ".join([plain[i] for i in ids[f : f + 4]]) for f in firsts)
        n_words = self.words_of[flat]
        start = _starts(size)
        total = np.r_[0, np.cumsum(n_words)]
        part_words = total[start + size] - total[start] if len(size) else size
        own = np.repeat(alone, size)
        per_doc = np.array(parts_of, np.int64)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        every = np.repeat(self.word_at[flat] - total[:-1], n_words) + np.arange(total[-1])
        values = {"words": self.words[every].view(np.int32), "part_words": part_words, "unit": unit, "tokens": self.hash[flat[own]].view(np.int32), "token_words": n_words[own], "part_tokens": np.where(alone, size, 0), "long": long, "skip": skip}
        docs = len(per_doc)
        lengths = {"words": np.bincount(doc, part_words, docs), "tokens": np.bincount(doc, np.where(alone, size, 0), docs)}
        lengths["token_words"] = lengths["tokens"]
        return {c: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths.get(c, per_doc))].astype(np.int32)), pa.array(np.asarray(values[c], np.int32))) for c in PARSED}


def parse_units(documents: DataFrame, keep: dict[str, str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """Whole texts parsed once for all that follows: ``doc_id``, the columns ``keep`` (name and type), ``size`` and PARSED.

    ``documents`` has ``doc_id, text`` and ``keep``. Null and blank texts are left out. ``size`` is the number of tokens of
    the vocabulary, if one is given. Further rows, which have ``first`` and ``n`` alone, count the first words of sentences.
    """
    kept = keep or {}
    schema = ", ".join(["doc_id bigint", *[f"{c} {t}" for c, t in kept.items()], "size int", _ARRAYS, "first string", "n bigint"])
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("text").to_pylist()
                good = [i for i, t in enumerate(texts) if not t.isspace()]
                b, texts = b.take(pa.array(good, pa.int64())), [texts[i] for i in good]
                cols = [b.column(c) for c in ("doc_id", *kept)]
                size = pa.array(count_tokens(texts, vocabulary), pa.int32()) if vocabulary else pa.nulls(len(texts), pa.int32())
                parsed = parser.parse(texts)
                yield batch([*cols, size, *[parsed[c].cast(ints) for c in PARSED], pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64())])
                if len(parser.firsts) > HELD_OPENINGS:
                    yield firsts(parser, whole.schema)
        if parser.firsts:
            yield firsts(parser, whole.schema)

    def firsts(parser: Parser, given: pa.Schema) -> pa.RecordBatch:
        n = len(parser.firsts)
        nulls = [pa.nulls(n, given.field(c).type) for c in ("doc_id", *kept)]
        out = batch([*nulls, pa.nulls(n, pa.int32()), *[pa.nulls(n, ints) for _ in PARSED], pa.array(list(parser.firsts), pa.string()), pa.array(list(parser.firsts.values()), pa.int64())])
        parser.firsts.clear()
        return out

    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *kept, "size", *PARSED, "first", "n"])

    return documents.select("doc_id", *kept, "text").filter("text <> ''").mapInArrow(run, schema)


class Parsed:
    """The parsed texts of a batch as flat arrays."""

    def __init__(self, b: pa.RecordBatch | dict[str, pa.Array]) -> None:
        column = (lambda c: b.column(c)) if isinstance(b, pa.RecordBatch) else b.__getitem__
        flat = {c: column(c).flatten().to_numpy(zero_copy_only=False) for c in PARSED}
        self.words, self.tokens = (flat[c].view(np.uint32) for c in ("words", "tokens"))
        self.part_words, self.unit, self.token_words, self.part_tokens, self.long, self.skip = (flat[c].astype(np.int64) for c in ("part_words", "unit", "token_words", "part_tokens", "long", "skip"))
        lengths = column("part_words").value_lengths().to_numpy(zero_copy_only=False)
        self.n_docs = len(lengths)
        self.doc = np.repeat(np.arange(self.n_docs), np.nan_to_num(lengths).astype(np.int64))
        self.word_start, self.token_start = _starts(self.part_words), _starts(self.part_tokens)

    def pieces(self, openings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts with long stretches cut at openings, as :func:`cut_long` does: document, unit and words of each."""
        cut_parts, cut_words = np.zeros(0, np.int64), np.zeros(0, np.int64)
        use = np.flatnonzero(self.long)
        if len(use) and len(openings):
            at, owner = _positions(self.token_start[use], self.part_tokens[use])
            hit = np.zeros(len(at), bool)
            for hashes in _hashes_at(self.tokens, at).values():
                hit |= _among(openings, hashes)
            parts, places = [], []
            last_part, last = -1, 0
            for o, i in zip(owner[hit].tolist(), at[hit].tolist()):
                p = use[o]
                if p != last_part:
                    last_part, last = p, self.token_start[p]
                if i - last >= 4:
                    parts.append(p), places.append(i)
                    last = i
            if parts:
                before = np.r_[0, np.cumsum(self.token_words)]
                cut_parts, cut_at = np.array(parts), np.array(places)
                cut_words = self.word_start[cut_parts] + before[cut_at] - before[self.token_start[cut_parts]]
        n = len(self.part_words)
        start, part, is_cut = np.r_[self.word_start, cut_words], np.r_[np.arange(n), cut_parts], np.r_[np.zeros(n, np.int64), np.ones(len(cut_parts), np.int64)]
        order = np.lexsort((start, is_cut, part))
        start, part, is_cut = start[order], part[order], is_cut[order]
        size = np.diff(np.r_[start, len(self.words)])
        unit = np.cumsum(np.where(is_cut == 1, 1, self.unit[part] if n else 0))
        kept = size > 0
        return self.doc[part[kept]], unit[kept], size[kept]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def _positions(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places after the first of each stretch from which four tokens follow in it, and the number of the stretch."""
    n = np.maximum(size - 4, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return start[owner] + 1 + np.arange(len(owner)) - np.repeat(_starts(n), n), owner


def _hashes_at(tokens: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind of opening the hash of the tokens from each place on."""
    wide = tokens.astype(np.uint64)
    out = {}
    for number, (kind, places) in enumerate(OPENINGS.items()):
        h = np.full(len(at), number + 1, np.uint64)
        for m, i in zip(MIX, places):
            h = h * np.uint64(MIX[0]) + wide[at + i] * np.uint64(m)
            h ^= h >> np.uint64(29)
        out[kind] = h
    return out


def pattern_hashes(openings: Iterable[tuple]) -> np.ndarray:
    """The hashes that :func:`_hashes_at` gives openings."""
    out = []
    for kind, *own in openings:
        tokens = np.zeros(4, np.uint32)
        for place, t in zip(OPENINGS[kind], own):
            tokens[place] = crc(t)
        out.append(_hashes_at(tokens, np.zeros(1, np.int64))[kind][0])
    return np.array(out, np.uint64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; a plain sort, which is faster than hashing for these."""
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[place] == values


@dataclass
class Model:
    """One-versus-rest linear classifiers over hashed n-grams, with a threshold per subject."""

    subjects: list[str]
    slots: dict[int, int]  # bucket -> line of weights; all others have line 0, which is zero
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    openings: frozenset

    def scores(self, grams: list[list[int]], hashed: bool = False) -> np.ndarray:
        """The evidence for each subject, a line per part: the linear score without the bias, so 0 is none. Grams of a
        part count once. ``hashed``: they are buckets, not lines."""
        if not grams:
            return np.zeros((0, len(self.subjects)), np.float32)
        own = [list(dict.fromkeys(g)) for g in grams]
        flat = np.fromiter((self.slots.get(k, 0) for g in own for k in g) if hashed else (k for g in own for k in g), np.int64)
        ends = np.cumsum([len(g) for g in own])
        return np.add.reduceat(self.weights[flat], np.r_[0, ends[:-1]], axis=0)


class Reader:
    """A model as arrays, for whole batches of parsed texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        keys = np.fromiter(model.slots.keys(), np.uint64, len(model.slots))
        order = np.argsort(keys, kind="stable")
        self.keys, self.lines = keys[order], np.fromiter(model.slots.values(), np.int64, len(model.slots))[order]
        self.openings = np.sort(pattern_hashes(model.openings))
        self.says = model.weights.any(1)  # lines with a weight

    def line(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(buckets), np.int64)
        place = np.minimum(np.searchsorted(self.keys, buckets), len(self.keys) - 1)
        return np.where(self.keys[place] == buckets, self.lines[place], 0)

    def read(self, parsed: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece its document, unit and evidence; and of each known n-gram its document and line."""
        doc, unit, size = parsed.pieces(self.openings)
        piece = np.repeat(np.arange(len(size)), size)
        w = parsed.words.astype(np.uint64)
        inside = np.flatnonzero(piece[1:] == piece[:-1]) if len(piece) else np.zeros(0, np.int64)
        lines = np.r_[self.line(w), self.line(pairs_of(w[inside], w[inside + 1]))]
        owner = np.r_[piece, piece[inside]]
        known = lines > 0
        # a part's n-grams count once
        owner, lines = np.divmod(_distinct(owner[known] * np.int64(len(self.model.weights)) + lines[known]), len(self.model.weights))
        z = np.zeros((len(size), len(self.model.subjects)), np.float32)
        says = self.says[lines]
        if says.any():
            own, some = owner[says], lines[says]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            z[own[first]] = np.add.reduceat(self.model.weights[some], first, axis=0)
        return doc, unit, z, doc[owner] if len(owner) else owner, lines


def fit_linear(grams: list[list[int]], labels: np.ndarray, weight: np.ndarray, n_subjects: int, common: frozenset = frozenset(), rounds: int = 120, l2: float = 2e-6, rate: float = 0.5) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Logistic one-versus-rest weights by AdaGrad over whole passes; ``labels`` -1 means no subject.

    Buckets in ``common`` get no weight.
    """
    # equal parts with equal labels are one part with their weights added up
    merged: dict[tuple, float] = defaultdict(float)
    for g, label, part in zip(grams, labels.tolist(), weight.tolist()):
        merged[label, tuple(dict.fromkeys(-1 if k in common else k for k in g))] += part
    own, labels, weight = [g for _, g in merged], np.array([label for label, _ in merged]), np.array(list(merged.values()))
    flat = np.fromiter((k for g in own for k in g), np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    sizes = np.array([len(g) for g in own])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    row = np.repeat(np.arange(len(own)), sizes)
    by_gram = np.argsort(flat, kind="stable")
    gram_starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(used)))[:-1]]
    rows_by_gram = row[by_gram]
    y = np.zeros((len(own), n_subjects), np.float32)
    y[np.flatnonzero(labels >= 0), labels[labels >= 0]] = 1
    w = np.zeros((len(used), n_subjects), np.float32)
    b = np.full(n_subjects, -2.0, np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    scale = (weight / max(weight.sum(), 1e-9)).astype(np.float32)[:, None]
    for _ in range(rounds):
        z = np.add.reduceat(w[flat], starts, axis=0) + b
        g = (1 / (1 + np.exp(-z)) - y) * scale
        dw = np.add.reduceat(g[rows_by_gram], gram_starts, axis=0) + l2 * w
        db = g.sum(0)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        w[used < 0] = 0
        b -= rate * db / np.sqrt(gb)
    slots = {int(k): i for i, k in enumerate(used[used >= 0], 1)}
    return slots, np.vstack([np.zeros((1, n_subjects), np.float32), w[used >= 0]]), b


def path_words(path: str | None) -> list[str]:
    """The words of an address path, its ending left out."""
    return words(path.rpartition(".")[0] or path) if path else []


#: For a model, by line the number of documents with a main subject that have the line's n-gram, and of how many of
#: them one subject is the main one; and the number of documents.
Spread = Callable[[Model], tuple[np.ndarray, np.ndarray, int]]


def fit(examples: list[tuple[str, str]], documents: list[tuple[str, str | None]], rounds: int = 2, openings: frozenset | None = None, spread: Spread | None = None) -> Model:
    """Fit on labelled texts and, by weak labels, on unlabelled ones.

    ``examples`` are ``(text, subject)``, ``documents`` ``(text, path)``. First the classifiers are fitted on the
    examples' units, each with its text's label. Then, ``rounds`` times, they label the documents' units weakly: a unit
    by its own score where that is clear; an unclear one, at a lower weight, by the words of the document's path that the
    classifiers know and by the subject that most of its section (the text between headings) is clearly about. Units
    of known, subject-free words are counter-examples. Texts whose label the others contradict are left out; the
    thresholds are set on the examples' units. Without examples the model has no subjects. Where the documents are a
    sample, ``openings`` and ``spread`` bring what is counted over all; else it is counted over ``documents``.
    """
    subjects = sorted({s for _, s in examples})
    place = {s: i for i, s in enumerate(subjects)}
    if openings is None:
        openings = learn_openings([t for t, _ in examples] + [t for t, _ in documents])
    hasher = Hasher()
    seed_grams, seed_labels, seed_doc = [], [], []
    for d, (text, s) in enumerate(examples):
        for unit in text_units(text, openings):
            for part in unit:
                seed_grams.append(hasher.grams(part))
                seed_labels.append(place[s])
                seed_doc.append(d)
    if not seed_grams:  # nothing to learn from: a model without subjects
        return Model([], {}, np.zeros((1, 0), np.float32), np.zeros(0, np.float32), np.zeros(0), openings)
    labels, doc = np.array(seed_labels), np.array(seed_doc)

    # units that say nothing carry their text's label too: what most other subjects also say is no evidence
    def seeded(keep: np.ndarray) -> Model:
        idx = np.flatnonzero(keep)
        slots, w, b = fit_linear([seed_grams[i] for i in idx], labels[idx], np.ones(len(idx)), len(subjects))
        return Model(subjects, slots, w, b, np.zeros(len(subjects)), openings)

    # a text that the classifiers fitted on the others place elsewhere has a doubtful label and is left out
    sound = np.ones(len(labels), bool)
    for fold in range(FOLDS):
        out = doc % FOLDS == fold
        if out.any() and not out.all():
            own = np.zeros((len(examples), len(subjects)))
            np.add.at(own, doc[out], _clear(seeded(~out).scores([seed_grams[i] for i in np.flatnonzero(out)], hashed=True)))
            wrong = (own.max(1) >= 2) & (own[np.arange(len(own)), [place[s] for _, s in examples]] < own.max(1) / 2)
            sound &= ~(out & wrong[doc])
    seed_grams, labels = [g for g, ok in zip(seed_grams, sound) if ok], labels[sound]
    model = seeded(np.ones(len(labels), bool))
    texts = []
    for text, path in documents:
        own = [part for unit in _sectioned(text, openings) for part in unit]
        if own:
            texts.append((own, path_words(path)))
    for _ in range(rounds):
        model = _refit(model, seed_grams, labels, texts, hasher, openings, len(documents), spread)
    model.thresholds = _calibrate(model, seed_grams, labels)
    return model


def _clear(z: np.ndarray) -> np.ndarray:
    """A line per part with 1 at the subject that it is clearly about, if any."""
    out = np.zeros(z.shape)
    if len(z):
        first, second = (np.partition(z, -2, 1)[:, -1], np.partition(z, -2, 1)[:, -2]) if z.shape[1] > 1 else (z[:, 0], np.zeros(len(z)))
        out[np.arange(len(z)), z.argmax(1)] = (first >= EVIDENCE) & (first - second >= LEAD)
    return out


def _sectioned(text: str, openings: frozenset) -> Iterator[list[tuple[int, list[str]]]]:
    """Units with the number of their section; headings start sections."""
    for section, piece in enumerate(re.split(r"(?m)^(?=#{1,6} )", text)):
        for unit in text_units(piece, openings):
            yield [(section, part) for part in unit]


def _widened(model: Model, buckets: set[int]) -> Model:
    """The model with a line for each of the buckets, zero for those that had none."""
    slots = {k: i for i, k in enumerate(sorted(buckets), 1)}
    w = np.zeros((len(slots) + 1, len(model.subjects)), np.float32)
    for k, i in model.slots.items():
        if k in slots:
            w[slots[k]] = model.weights[i]
    return Model(model.subjects, slots, w, model.bias, model.thresholds, model.openings)


def _add_main(model: Model, grams: list[list[int]], counts: np.ndarray) -> None:
    """Count a document's n-grams, given as lines, under the subject that most of its parts are clearly about, if any."""
    if grams:
        whole = _clear(model.scores(grams)).sum(0)
        if whole.max() > 0:
            counts[np.unique(np.fromiter((k for g in grams for k in g), np.int64)), whole.argmax()] += 1


def spread_of(documents: DataFrame, text: str = "text", parsed: DataFrame | None = None) -> Spread:
    """What ``fit`` counts of n-grams, over all documents of a table, whole texts read.

    Only n-grams with a line in the model are counted, which are those of the fitting sample: a task holds one number
    for each and each subject. ``parsed`` are the documents as :func:`parse_units` gives them, if that is done.
    """
    spark = documents.sparkSession
    n_docs = documents.filter(F.col(text).isNotNull()).count()
    units_ = parse_units(documents.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text).alias("text"))) if parsed is None else parsed

    def spread(model: Model) -> tuple[np.ndarray, np.ndarray, int]:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            n_lines, n_subjects = reader.model.weights.shape
            counts = np.zeros(n_lines * n_subjects, np.int32)
            for p in (Parsed(b.slice(at, 1000)) for b in batches for at in range(0, b.num_rows, 1000)):
                doc, _, z, gram_doc, lines = reader.read(p)
                whole = np.zeros((p.n_docs, n_subjects))
                np.add.at(whole, doc, _clear(z))
                gram_doc, lines = np.divmod(_distinct(gram_doc * np.int64(n_lines) + lines), n_lines)
                told = whole[gram_doc].max(1, initial=0) > 0
                np.add.at(counts, lines[told] * n_subjects + whole.argmax(1)[gram_doc[told]], 1)
            lines, subjects = np.divmod(found := counts.nonzero()[0], n_subjects)
            for at in range(0, len(found), 100_000):
                cut_ = slice(at, at + 100_000)
                yield pa.RecordBatch.from_pydict({"line": pa.array(lines[cut_], pa.int32()), "subject": pa.array(subjects[cut_], pa.int32()), "n": pa.array(counts[found[cut_]], pa.int64())})

        by_subject = units_.filter("words IS NOT NULL").select(*PARSED).mapInArrow(run, "line int, subject int, n bigint").groupBy("line", "subject").agg(F.sum("n").alias("n"))
        found = by_subject.groupBy("line").agg(F.sum("n").alias("total"), F.max("n").alias("most")).toArrow()
        total, most = np.zeros((2, len(model.weights)), np.int64)
        lines = found["line"].to_numpy()
        total[lines], most[lines] = found["total"].to_numpy(), found["most"].to_numpy()
        shared.unpersist()
        return total, most, n_docs

    return spread


def _refit(model: Model, seed_grams: list, seed_labels: np.ndarray, texts: list, hasher: Hasher, openings: frozenset, n_docs: int, spread: Spread | None) -> Model:
    grams = list(seed_grams)
    # a part of an example in which its subject has no evidence is a counter-example
    z = model.scores(seed_grams, hashed=True)
    labels = list(np.where(z[np.arange(len(z)), seed_labels] >= NONE, seed_labels, -1))
    weight = [1.0] * len(grams)
    read: list[tuple] = []
    singles: set[int] = set()
    pairs: set[int] = {k for g in seed_grams for k in g[len(g) // 2 + 1 :]}
    for parts, path in texts:
        gs = [hasher.grams(ws) for _, ws in parts]
        for g in gs:  # words come before pairs
            singles.update(g[: len(g) // 2 + 1])
            pairs.update(g[len(g) // 2 + 1 :])
        z = model.scores(gs, hashed=True)
        about = _clear(z)
        votes: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(model.subjects)))
        for (section, _), a in zip(parts, about):
            votes[section] += a
        if path:
            zp = model.scores([hasher.grams(path)], hashed=True)
            for v in votes.values():
                v += _clear(zp)[0]
        read.append((parts, gs, z, about, votes))
    wide = _widened(model, singles | pairs | model.slots.keys())
    if spread is None:
        counts = np.zeros(wide.weights.shape, np.int32)
        for _, gs, *_ in read:
            _add_main(wide, [[wide.slots[k] for k in g] for g in gs], counts)
        total, most = counts.sum(1), counts.max(1)
    else:
        total, most, n_docs = spread(wide)
    often = total >= max(COMMON_DOCUMENTS, COMMON_PART * n_docs)
    anywhere = often & (most - 1.65 * most**0.5 <= COMMON_SHARE * total)
    common = {k for k in singles | pairs if anywhere[i := wide.slots[k]] or not often[i] and k not in singles}
    known = {k for k in singles - common if total[wide.slots[k]] >= max(KNOWN_DOCUMENTS, KNOWN_PART * n_docs)}
    for parts, gs, z, about, votes in read:
        for (section, _), g, zs, a in zip(parts, gs, z, about):
            v = votes[section]
            if a.any():
                grams.append(g), labels.append(int(zs.argmax())), weight.append(1.0)
            elif zs.max() < NONE and common.issuperset(g[: len(g) // 2 + 1]):
                grams.append(g), labels.append(-1), weight.append(1.0)
            elif v.max() >= 2 and v.max() >= 0.7 * v.sum() and any(k in known for k in g[: len(g) // 2 + 1]):
                grams.append(g), labels.append(int(v.argmax())), weight.append(0.3)
    slots, w, b = fit_linear(grams, np.array(labels), np.array(weight), len(model.subjects), frozenset(common))
    return Model(model.subjects, slots, w, b, model.thresholds, openings)


def _calibrate(model: Model, grams: list, labels: np.ndarray) -> np.ndarray:
    """Per subject the evidence from which a part counts: the best F1 over the examples' parts.

    Parts in which no subject has any evidence count for none. Of equally good thresholds one from the lower
    part of their range is taken.
    """
    z = model.scores(grams, hashed=True)
    said = z.max(1) >= NONE
    out = np.zeros(len(model.subjects))
    for s in range(len(model.subjects)):
        mine = (labels == s) & said
        tries = np.arange(0.5, 3.51, 0.25)
        f1 = []
        for t in tries:
            hit = (z[:, s] >= t) & (z.argmax(1) == s)
            f1.append(2 * (hit & mine).sum() / max(hit.sum() + mine.sum(), 1))
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-3)
        out[s] = tries[best[len(best) // 4]]
    return out


def classify_batch(model: Model, hasher: Hasher, texts: list[str | None]) -> list[dict[str, int]]:
    """For each text the number of units about each subject.

    A part is about the subject with most evidence, if that reaches the subject's threshold. Where others come close (a
    word of two subjects), the share of each in the text's clear parts adds to its evidence. A subject that no part is
    clearly about doesn't count. A unit counts once per subject.
    """
    columns = Parser().parse([t if t and not t.isspace() else None for t in texts])
    out: list[dict[str, int]] = [{} for _ in texts]
    for d, s, n in zip(*(x.tolist() for x in classify_parsed(Reader(model), Parsed(columns)))):
        out[d][model.subjects[s]] = n
    return out


def classify_parsed(reader: Reader, parsed: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`classify_batch` gives, for parsed texts: number of the text, number of the subject, units about it."""
    model = reader.model
    none = np.zeros(0, np.int64)
    if not model.subjects:
        return none, none, none
    doc, unit, z, _, _ = reader.read(parsed)
    if not len(z):
        return none, none, none
    whole = np.zeros((parsed.n_docs, len(model.subjects)))
    np.add.at(whole, doc, _clear(z))
    share = CONTEXT * np.log(whole / np.maximum(whole.sum(1, keepdims=True), 1) + 0.05)
    best = np.where((z >= z.max(1, keepdims=True) - NEAR) & (z >= model.thresholds), z + share[doc], z - 1e6).argmax(1)
    at = np.arange(len(z))
    enough = (z[at, best] >= model.thresholds[best]) & (whole[doc, best] > 0)
    n_units = int(unit.max()) + 1
    told = _distinct((doc[enough] * len(model.subjects) + best[enough]) * n_units + unit[enough]) // n_units  # a unit counts once per subject
    first = np.flatnonzero(np.r_[True, told[1:] != told[:-1]]) if len(told) else none
    return (*np.divmod(told[first], len(model.subjects)), np.diff(np.r_[first, len(told)]))


def fit_from(examples: DataFrame, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", fit_documents: int = FIT_DOCUMENTS, parsed: DataFrame | None = None) -> Model:
    """Fit on all examples; weights also on at most ``fit_documents`` whole documents, those with the smallest hashes of
    their ids. Sentence openings and the documents of n-grams are counted over all documents; ``parsed`` are these as
    :func:`parse_units` gives them, else they are parsed here, once."""
    given = examples.select("text", F.lower(F.trim("subject")).alias("subject")).filter("text IS NOT NULL AND trim(text) <> '' AND subject <> ''")
    if not (labelled := [(r.text, r.subject) for r in given.collect()]):
        return fit([], [], openings=frozenset())
    there = documents.filter(F.col(text).isNotNull())
    if parsed is None:
        parsed = cut(parse_units(there.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))))
    columns = [*PARSED, "first", "n"]
    own = cut(parse_units(given.select(F.lit(None).cast("bigint").alias("doc_id"), "text")))
    openings = learned_openings(parsed.select(*columns).unionByName(own.select(*columns)))
    some = there.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("t"), F.col(path).alias("p")).orderBy("h").limit(fit_documents).collect()
    return fit(sorted(labelled), [(r.t, r.p) for r in some], openings=openings, spread=spread_of(documents, text, parsed))


def subject_units(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", parsed: DataFrame | None = None) -> DataFrame:
    """``doc_id, subject, units``: for each document the number of its units about each subject, whole texts read.

    Defined cases: null and blank texts and texts about nothing give no rows; a repeated document id gives its rows
    as often; null ids are kept; other columns are ignored. ``parsed`` are the documents as :func:`parse_units` gives them.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as large as the bounded fitting sample, however many documents there are
    if parsed is None:
        parsed = parse_units(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        names = np.array(reader.model.subjects, object)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                docs, subjects, ns = classify_parsed(reader, Parsed(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(names[subjects] if len(names) else [], pa.string()), pa.array(ns, pa.int32())], names=["doc_id", "subject", "units"])

    return parsed.filter("words IS NOT NULL").select("doc_id", *PARSED).mapInArrow(run, "doc_id bigint, subject string, units int")


def document_subjects(documents: DataFrame, model: Model, min_units: int = MIN_UNITS, doc_id: str = "doc_id", text: str = "text", parsed: DataFrame | None = None) -> DataFrame:
    """``doc_id, subject, units`` of the subjects at least ``min_units`` units of a document are about."""
    return subject_units(documents, model, doc_id, text, parsed).filter(F.col("units") >= min_units)
