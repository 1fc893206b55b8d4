"""Best-fit packing of token sequences into bins of a fixed capacity, by large-item matching.

Lengths are whole numbers up to the capacity, so their histogram, of at most `capacity` rows, is all that the packing
itself looks at. It is solved on the driver by counts: items above a third of the capacity fit at most twice in a bin and
are matched greedily, each with the largest that still fits; smaller items then go, largest first, to the tightest gap.
Every step treats all equal bins at once, so the plan has a few thousand rows at most, whatever the number of documents.
Spark then numbers the pieces of each length and looks up each one's place in the plan. Numbers come from two levels:
counts of hashed chunks of a length, then a rank within a chunk; so a length that a third of all pieces share is split.

Null and empty texts are documents of no tokens: they have the end id alone. Repeated rows are packed each, as separate
pieces; a null doc_id is packed like any other. Documents longer than the capacity, and only those, are cut. Pieces of
equal length are told apart by doc_id, place and content; those equal in all of these may change places. Other columns are
passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclemill.llm.shared import Words, code_points, lean, ranked, slices, stored, table, utf8, widened

CAPACITY = 2048
END_ID = 0
#: Texts are worked on in slices of so many bytes; with 8 MB a worker took 180 MB more and was no faster.
SLICE = 1 << 20
#: Words whose ids a worker keeps; more are encoded again.
REMEMBERED = 300_000


# ---------------------------------------------------------------- the plan


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in a bin) of a packing of so many items of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    bins: list[tuple[int, tuple[int, ...]]] = []
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            k, items = left[n], (n,)
        elif mate == n:
            k, items = left[n] // 2, (n, n)
            if not k:  # one is left over: the next smaller one joins it
                mate = large[at - 1] if at else None
                k, items = 1, (n,) if mate is None else (n, mate)
        else:
            k, items = min(left[n], left[mate]), (n, mate)
        bins.append((k, items))
        for x in items:
            left[x] -= k
            if not left[x]:
                large.remove(x)
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for k, items in bins:
        open_[capacity - sum(items)].append((k, items))
    gaps = sorted(open_)
    done = []

    def put(gap: int, group: tuple[int, tuple[int, ...]]) -> None:
        if gap not in open_ or not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append(group)

    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        need = left[n]
        while need:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                fresh = -(-need // (capacity // n))
                put(capacity, (fresh, ()))
                continue
            gap = gaps[at]
            k, items = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            each = gap // n
            full = min(k, need // each)
            if full:
                put(gap - each * n, (full, items + (n,) * each))
                need -= full * each
            if full < k and need:
                put(gap - need * n, (1, items + (n,) * need))
                full, need = full + 1, 0
            if full < k:
                put(gap, (k - full, items))
    for groups in open_.values():
        done += groups
    return [(k, items) for k, items in done if items]


class Places:
    """For each length the ranks' places: from rank `start` on, a new bin each, from number `bin` on, at `offset`."""

    def __init__(self, packing: list[tuple[int, tuple[int, ...]]]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        first = 0
        for k, items in packing:
            offset = 0
            for n in items:
                rows[n].append((used[n], first, offset))
                used[n] += k
                offset += n
            first += k
        self.rows = {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            own = lengths == n
            start, first, off = self.rows[n]
            at = np.searchsorted(start, ranks[own], "right") - 1
            number[own], offset[own] = first[at] + ranks[own] - start[at], off[at]
        return number, offset


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length, int) with sequence_id and offset. key names columns that tell pieces apart, for the order."""
    pieces = pieces.drop("sequence_id", "offset")
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in rows}
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    numbered = ranked(pieces, ["length"], key, max(counts.values(), default=1))

    def run(batches):
        for batch in batches:
            number, offset = places.value.find(batch.column("length").to_numpy().astype(np.int64), batch.column("rank_").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(lean(run), widened(pieces, "sequence_id long, offset long"))


# ---------------------------------------------------------------- tokens

#: The tokenizer file's own pattern of its split step, a fixed value.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: How all special tokens of the tokenizer file begin.
SPECIAL = b"<|"


def normal(text: str) -> str:
    """As the tokenizer file's normalizer, but for its white space: composed, and lower case character by character."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


@functools.cache
def odd_points(path: str) -> np.ndarray:
    """Whether the tokenizer normalizes or splits a code point in another way than Python here does: its Unicode tables are
    of another version. Code points that Python does not know count as odd."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    odd = np.ones(0x110000, bool)
    known = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    odd[known] = False
    marks = [c for c in known if unicodedata.combining(chr(c))]
    same = lambda text: tokenizer.normalizer.normalize_str(text) == normal(text)
    for c in known:
        x = chr(c)
        if regex.match(r"\s", x):
            continue  # the splits below tell
        whole = unicodedata.normalize("NFD", x)
        odd[c] = not same(x)
        if whole != x and not same(whole):
            odd[[ord(y) for y in whole]] = True
    for c in marks:  # their order among others
        odd[c] |= not (same(f"a{chr(c)}\u0323") and same(f"a\u0323{chr(c)}") and same(f"a{chr(c)}\u0345\u0334"))
    for i in range(0, len(known), 4096):
        some = known[i : i + 4096]
        text = "".join(f"a{chr(c)}{chr(c)} " for c in some)
        spans = {span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        for start, _ in spans ^ {m.span() for m in PRE_TOKEN.finditer(text)}:
            odd[some[start // 4]] = True
    return odd


#: Classes of code points: white space, letters, numbers, others; ODD is added to those of an odd one.
SPACE, LETTER, NUMBER, OTHER, ODD = 0, 1, 2, 3, 4


@functools.cache
def classes(path: str) -> bytes:
    """The class of each code point, compressed."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            out[a:b] = kind
    return zlib.compress((out | ODD * odd_points(path).astype(np.uint8)).tobytes())


def pre_tokens(text: str, kinds: np.ndarray) -> tuple[list[str], np.ndarray]:
    """What PRE_TOKEN finds in a text, and where each begins: runs of letters, single numbers, runs of others; but a single
    apostrophe takes an ending after it along."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = kinds[points]
    change = kind[1:] != kind[:-1]
    begin = np.concatenate([[True], change | (kind[1:] == NUMBER)])
    for p in np.flatnonzero(points == ord("'")).tolist():
        if begin[p] and p + 1 < len(points) and kind[p + 1] == LETTER:
            n = 1 if text[p + 1] in "stmd" else 2 if text[p + 1 : p + 3] in ("re", "ve", "ll") else 0
            if n:
                begin[p + 1] = False
                if p + 1 + n < len(points):
                    begin[p + 1 + n] = True
    at = np.flatnonzero(begin)
    ends = np.append(at[1:], len(points))
    own = kind[at] != SPACE
    at, ends = at[own], ends[own]
    return [text[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)], at


class WordIds:
    """Token ids by a tokenizer that drops white space and ends each pre-token's last token with '</w>'.

    No token of it spans white space, so a text's ids are those of its words one after another, and a word's are those of
    its pre-tokens. Only pre-tokens not met before are given to the tokenizer, many at once; which ids are whose is told
    by the ends. Texts with a code point that is odd, or with the begin of a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, kinds: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        both = np.frombuffer(zlib.decompress(kinds), np.uint8)
        self.odd, self.kinds = both >= ODD, both & (ODD - 1)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """known: a number for each pre-token; its ids are size[number] ones from start[number] on in flat."""
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens one after another, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) == len(parts) and (not len(ids) or stop[-1] == len(ids)):
            return ids, np.diff(stop, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def apart(self, words: list[bytes]) -> np.ndarray:
        """Which words make their texts go to the tokenizer whole."""
        out = np.array([SPECIAL in w for w in words], bool) if SPECIAL in b" ".join(words) else np.zeros(len(words), bool)
        points, number = code_points(words)
        out[number[np.flatnonzero(self.odd[points])]] = True
        return out

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        text = normal(b"\n".join([*words, b""]).decode("utf-8", "replace"))
        parts, at = pre_tokens(text, self.kinds) if words else ([], np.zeros(0, np.int64))
        known = self.known
        number = np.fromiter(map(known.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(number < 0).tolist()
        fresh = list(dict.fromkeys(parts[i] for i in new))
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        number[new] = [known[parts[i]] for i in new]
        made = [self._encode(fresh[i : i + 50_000]) for i in range(0, len(fresh), 50_000)]
        self.flat, self.size = np.concatenate([self.flat, *(x for x, _ in made)]), np.concatenate([self.size, *(n for _, n in made)])
        size = self.size[number]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat((np.cumsum(self.size) - self.size)[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord("\n"))  # the end of each word
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(at, stops)], prepend=0)


@functools.cache
def word_ids(path: str, kinds: bytes) -> WordIds:
    return WordIds(path, kinds)


def document_ids(texts: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids, each with END_ID after it, and their ends."""
    words = Words(texts)
    apart = ids.apart(words.distinct)
    whole = np.unique(words.text[apart[words.codes]]) if apart.any() else np.zeros(0, np.int64)
    if len(whole):
        texts = list(texts)
        for i in whole.tolist():
            texts[i], whole_text = b"", texts[i]
            texts.append(whole_text)
        kept, more = texts[: len(words.counts)], ids.whole(texts[len(words.counts) :])
        words = Words(kept)
    flat, sizes = ids.of(words.distinct)
    starts = np.cumsum(sizes) - sizes
    own = sizes[words.codes]
    at = np.cumsum(own)
    tokens = flat[np.repeat(starts[words.codes] - (at - own), own) + np.arange(at[-1] if len(at) else 0)]
    lengths = np.bincount(words.text, weights=own, minlength=len(words.counts)).astype(np.int64)
    by_words = lengths.copy()
    if len(whole):
        lengths[whole] = [len(x) for x in more]
    ends = np.cumsum(lengths + 1)
    out = np.full(ends[-1] if len(ends) else 0, END_ID, "<u4")
    put = np.repeat(ends - lengths - 1 - (np.cumsum(by_words) - by_words), by_words) + np.arange(len(tokens))
    out[put] = tokens
    for i, x in zip(whole.tolist(), more if len(whole) else [], strict=True):
        out[ends[i] - 1 - len(x) : ends[i] - 1] = x
    return out, ends


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs with doc_id and text."""
    kinds = classes(path)  # some 10 KB

    def run(batches):
        ids = word_ids(path, kinds)
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                tokens, ends = document_ids(utf8(batch.column("text").slice(a, b - a)), ids)
                rows = []
                begin = 0
                for i, end in enumerate(ends.tolist()):
                    rows += [(i, k, at - begin, min(capacity, end - at), zlib.crc32(tokens[at : min(at + capacity, end)])) for k, at in enumerate(range(begin, end, capacity))]
                    begin = end
                who, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(who)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(stored(tokenized(docs, path, capacity)), ["doc_id", "piece", "start", "ids_crc32"], capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
