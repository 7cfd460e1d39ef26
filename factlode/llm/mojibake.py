"""Text that was read in a wrong encoding: improbable runs by corpus mutual information, and the inverse readings inside them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlode.llm.bpe import codes
from factlode.llm.encode import slices
from factlode.runtime import materialise

POINTS = 0x110000
#: Pairs rarer than this part of all characters have no mutual information worth the name; so at most 1 / SHOWN pairs are ever sent around.
SHOWN = 1e-6
#: Occurrences that may be chance: so many of a pair tell nothing.
FEW = 5
#: Bits of a pair and of a character that are rarer than can be told.
UNSEEN_PAIR, UNSEEN = -24.0, -30.0
#: Bits of shrunken mutual information below which a pair is improbable, the least a pair can take from a run, and
#: pairs per million at which its information counts half.
PROBABLE, FLOOR, HALF = 0.6, -2.0, 300.0
#: Least score of a run that is tried.
LEAST = 0.3
#: Parts of one that scores are rounded to before they are summed.
FINE = 1 << 20
#: Bits per character by which a reading through two-byte encodings must be likelier than the text.
GAIN = 3.0
#: Mean bits of the characters beyond ASCII of a run below which such readings are tried.
RARE = -13.0

#: One-byte encodings that text is wrongly read in.
ONE_BYTE = ["cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "koi8_r", "cp866", "cp850", "cp852", "cp1250", "iso8859_15", "iso8859_5", "mac_cyrillic"]
#: Pairs of encodings, as read and as written, of which one has two bytes.
TWO_BYTE = [("gbk", "utf_8"), ("cp932", "utf_8"), ("cp950", "utf_8"), ("cp949", "utf_8"), ("gbk", "cp950"), ("cp950", "gbk"), ("cp932", "cp950"), ("cp932", "gbk"), ("latin_1", "cp950"), ("cp1252", "cp950"), ("latin_1", "gbk"), ("cp1252", "gbk"), ("mac_roman", "cp950"), ("cp437", "cp950")]
BROKEN = "�"


def _no_character(cp: np.ndarray) -> np.ndarray:
    """Code points that stand for no character of their own: the replacement character and a symbol font's private ones."""
    return (cp == 0xFFFD) | ((cp >= 0xF020) & (cp <= 0xF07E))


def pair_counts(df: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Exact counts over all texts: pairs of neighbours that make up SHOWN of all characters or more (as first << 21 | second, in order), how
    often each stands, how often each code point stands, and the number of characters.  What stands for no character is in no pair.
    Equal texts count once: a damaged passage that is copied many times says nothing new about which characters go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = np.zeros(POINTS, np.int64)

        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            for _, _, blob, sizes in slices(batch.column(0)):
                cp = codes(blob)
                chars += np.bincount(cp, minlength=POINTS)
                inside = np.ones(max(len(cp) - 1, 0), bool)
                ends = np.cumsum(sizes)
                inside[(ends[(ends > 0) & (ends < len(cp))] - 1)] = False
                none = _no_character(cp)
                inside &= ~(none[1:] | none[:-1])
                yield out(*np.unique(cp[:-1][inside].astype(np.int64) << 21 | cp[1:][inside], return_counts=True))
        at = np.flatnonzero(chars)
        yield out(at | 1 << 42, chars[at])

    counts = materialise(df.select(F.col(text_col).cast("string").alias("text")).distinct().mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    single = counts.where(F.col("key") >= 1 << 42).toArrow()  # at most POINTS rows
    chars = np.zeros(POINTS, np.int64)
    chars[single.column("key").to_numpy() - (1 << 42)] = single.column("n").to_numpy()
    total = int(chars.sum())
    pairs = counts.where((F.col("key") < 1 << 42) & (F.col("n") >= SHOWN * total)).orderBy("key").toArrow()  # at most 1 / SHOWN rows
    return pairs.column("key").to_numpy(), pairs.column("n").to_numpy(), chars, total


class _Places:
    """Where whole-number keys stand in an array, by as many hashed tables as it takes to hold each once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys))
        self.bits = max(10, int(len(keys)).bit_length() + 2)
        while len(left):
            table = np.full(1 << self.bits, -1, np.int32)
            h = self._hash(keys[left], len(self.tables))
            table[h] = left
            self.tables.append(table)
            left = left[table[h] != left]

    def _hash(self, keys: np.ndarray, turn: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, the length of the array where it is none."""
        n = len(self.keys)
        out = np.full(len(keys), n, np.int64)
        rest = np.arange(len(keys))
        for turn, table in enumerate(self.tables):
            at = table[self._hash(keys[rest], turn)]
            same = (at >= 0) & (self.keys[np.maximum(at, 0)] == keys[rest])
            out[rest[same]] = at[same]
            rest = rest[~same & (at >= 0)]
        return out


class Model:
    """How probable neighbours are in the corpus."""

    def __init__(self, keys: np.ndarray, pairs: np.ndarray, chars: np.ndarray, total: int):
        total = max(total, 1)
        self.places = _Places(keys)
        # the last stands for all rarer pairs
        sure = np.append(np.maximum(pairs - FEW, 0) / total, 0.0) * 1e6
        self.share = (sure / (sure + HALF)).astype(np.float32)
        self.pair_bits = np.append(np.log2(pairs / total), UNSEEN_PAIR).astype(np.float32)
        self.bits = np.maximum(np.log2(np.maximum(chars, 1e-9) / total), UNSEEN).astype(np.float32)
        self.seen = chars / total > 2e-6

        self._judged: dict[tuple[str, str], bool] = {}

    def _pairs(self, cp: np.ndarray) -> np.ndarray:
        return self.places.of(cp[:-1].astype(np.int64) << 21 | cp[1:])

    def plausible(self, was: str, good: str) -> bool:
        """Whether a short reading may stand for what was read: box drawings and what is far less likely may not."""
        if (was, good) not in self._judged:
            if len(self._judged) > 100_000:
                self._judged.clear()
            self._judged[was, good] = max(map(ord, good)) >= 0x800 or not (_BOX.search(was) or self.likelihood(good) < self.likelihood(was) - 8)
        return self._judged[was, good]

    def scores(self, cp: np.ndarray) -> np.ndarray:
        """How improbable each pair is: PROBABLE less its mutual information, shrunken where it is rare."""
        k = self._pairs(cp)
        mutual = (self.pair_bits[k] - self.bits[cp[:-1]] - self.bits[cp[1:]]) * self.share[k]
        return np.maximum(PROBABLE - mutual, FLOOR)

    def likelihood(self, text: str) -> float:
        """Mean bits of a character, the average of its own and its pairs'."""
        cp = codes(text)
        if not len(cp):
            return -40.0
        one = float(self.bits[cp].mean())
        if len(cp) == 1:
            return one
        return 0.5 * one + 0.5 * float(self.pair_bits[self._pairs(cp)].mean())


def segments(s: np.ndarray, worth: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """First and last place of each maximum-scoring run of ``s`` of at least ``least`` that holds a place of ``worth``."""
    # sums of whole numbers are exact, so a run comes out the same wherever it stands
    s, least = np.rint(s.astype(np.float64) * FINE).astype(np.int64), round(least * FINE)
    found, parts = [], [(0, s, np.concatenate([[0], np.cumsum(worth)]))]
    while parts:
        more = []
        for base, x, marks in parts:
            run = np.cumsum(x)
            r = run - np.minimum(np.minimum.accumulate(run), 0)
            edge = np.diff(np.concatenate([[0], (r > 0).view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            some = marks[end] > marks[begin]
            for a, b in zip(begin[some].tolist(), end[some].tolist()):
                peak = a + int(np.argmax(r[a:b]))
                if r[peak] >= least and marks[peak + 1] > marks[a]:
                    found.append((base + a, base + peak))
                if b - peak > 2 and marks[b] > marks[peak + 1]:
                    more.append((base + peak + 1, x[peak + 1 : b], marks[peak + 1 : b + 1]))
        parts = more
    return sorted(found)


@lru_cache(64)
def _to_bytes(name: str) -> dict[str, int]:
    """The byte of each character of a one-byte encoding; bytes it leaves free stand for the control of that number."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(64)
def _table(name: str) -> np.ndarray:
    """The byte of each code point, 0 where it has none."""
    out = np.zeros(POINTS, np.uint8)
    out[:128] = np.arange(128)
    for c, b in _to_bytes(name).items():
        out[ord(c)] = b
    return out


@lru_cache(1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """By code point, the one-byte encodings in which it begins and in which it continues a UTF-8 character."""
    lead, cont = np.zeros(POINTS, np.uint32), np.zeros(POINTS, np.uint32)
    for i, name in enumerate(ONE_BYTE):
        for c, b in _to_bytes(name).items():
            if 0xC2 <= b <= 0xF4:
                lead[ord(c)] |= 1 << i
            elif b < 0xC0:
                cont[ord(c)] |= 1 << i
    return lead, cont


_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_BOX = re.compile("[─-▟]")


def _one_byte(text: str, cp: np.ndarray, which: int, model: Model) -> tuple[list[tuple[int, int, str]], int]:
    """Readings of UTF-8 through the one-byte encodings of the bit set ``which``: the spans they restore, by the encoding that restores most."""
    best: tuple[list[tuple[int, int, str]], int] = ([], 0)
    for i, name in enumerate(ONE_BYTE):
        if not which >> i & 1:
            continue
        raw = _table(name)[cp].tobytes().decode("latin_1")
        spans, size = [], 0
        for m in _UTF8.finditer(raw):
            try:
                good = m[0].encode("latin_1").decode("utf_8")
            except UnicodeDecodeError:
                continue
            was = text[m.start() : m.end()]
            # four characters in a row that are whole ones of UTF-8 do not happen by chance
            if len(good) < 4 and not model.plausible(was, good) or not all(_usual(c, model) for c in set(good)):
                continue
            spans.append((m.start(), m.end(), good))
            size += m.end() - m.start()
        if size > best[1]:
            best = (spans, size)
    return best


def _usual(c: str, model: Model) -> bool:
    """Whether a restored character is one that texts have: of the corpus, of the East Asian blocks, punctuation or symbols, or still to be read again."""
    x = ord(c)
    return model.seen[x] or 0x80 <= x < 0x180 or 0x2000 <= x < 0x2800 or 0x2E80 <= x < 0xA000 or 0xAC00 <= x < 0xD7A4 or 0xF900 <= x < 0xFB00 or 0xFE30 <= x < 0xFE50 or 0xFF00 <= x < 0xFFEF or 0x20000 <= x < 0x32000


def _cjk(text: str) -> int:
    return sum("一" <= c <= "鿿" or c in "，。、；：「」％（）" for c in text)


def _swap(text: str) -> str:
    return np.frombuffer(text.encode("utf_16_le", "surrogatepass"), np.uint16).byteswap().tobytes().decode("utf_16_le", "replace")


def _reread(text: str, read: str, written: str) -> str | None:
    """``text`` as bytes of ``read`` decoded as ``written``; None where that cannot be or loses much."""
    if read == "swap":
        good = _swap(text)
        return good if good.count(BROKEN) * 4 <= len(good) else None
    try:
        raw = text.replace(BROKEN, "").encode(read)
    except UnicodeEncodeError:
        return None
    good = raw.decode(written, "replace")
    lost = good.count(BROKEN)
    return None if lost * 3 > len(good) or (lost > 1 and BROKEN not in text) or _cjk(good) < 2 else good


def _two_byte(text: str, model: Model) -> tuple[int, int, str] | None:
    """The likeliest reading of ``text`` through two-byte encodings or swapped bytes, if it gains enough: the part it restores."""
    now, best, gain = model.likelihood(text.replace(BROKEN, "")), None, GAIN
    for read, written in [*TWO_BYTE, ("swap", "")]:
        if (good := _reread(text, read, written)) is None:
            continue
        g = model.likelihood(good.replace(BROKEN, "")) - now - 4.0 * good.count(BROKEN) / len(good)
        if g > gain:
            best, gain = (read, written, good), g
    if best is None:
        return None
    # characters in order at the ends of the run stay as they are, if the whole is likelier so
    total = lambda t: model.likelihood(t.replace(BROKEN, "")) - 4.0 * t.count(BROKEN) / max(len(t), 1)
    read, written, good = best
    tried = [(total(good), 0, len(text), good)]
    for i in range(4):
        for j in range(4):
            if i + j and i + j + 2 <= len(text) and (g := _reread(part := text[i : len(text) - j], read, written)) is not None:
                tried.append((total(text[:i] + g + text[len(text) - j :]), i, len(text) - j, g))
    _, i, j, good = max(tried)
    return i, j, good


_PRIVATE = re.compile("[\uf020-\uf07e]+")
_BULLET = re.compile(r"(?:^|[\n\r\x0b\x0c\x85  ])[ \t　]*$")


def _symbols(text: str) -> list[tuple[int, int, str]]:
    """Spans of a symbol font's private code points that stand for ASCII; a lone one that leads a line or stands between spaces is a bullet."""
    out = []
    for m in _PRIVATE.finditer(text):
        if m.end() - m.start() == 1 and (_BULLET.search(text[: m.start()][-40:]) or not text[m.start() - 1 : m.start()].strip() and not text[m.end() : m.end() + 1].strip()):
            continue
        out.append((m.start(), m.end(), "".join(chr(ord(c) - 0xF000) for c in m[0])))
    return out


def repair(text: str, runs: list[tuple[int, int, bool]], model: Model, cp: np.ndarray | None = None) -> tuple[str, int, int] | None:
    """The text with all that can be read again put right, how many characters were wrong, and how many stay so; None where nothing is wrong.

    runs: improbable runs (first character, end, whether its characters are rare).  Readings are tried inside them only.
    """
    lead, cont = _masks()
    cp = codes(text) if cp is None else cp
    marks: list[tuple[int, int, str | None]] = []
    for a, b, rare in runs:
        span, c = text[a:b], cp[a:b]
        which = int(np.bitwise_or.reduce(lead[c[:-1]] & cont[c[1:]])) if b - a > 1 else 0
        if which:
            spans, size = _one_byte(span, c, which, model)
            # a text that was read wrongly twice is read again
            for s, e, good in spans:
                g = codes(good)
                again = int(np.bitwise_or.reduce(lead[g[:-1]] & cont[g[1:]])) if len(g) > 1 else 0
                if again:
                    deeper, _ = _one_byte(good, g, again, model)
                    for x, y, better in reversed(deeper):
                        good = good[:x] + better + good[y:]
                marks.append((a + s, a + e, good))
            if size * 2 > b - a:
                continue
        for s, e, good in _symbols(text[max(0, a - 40) : b + 1]):
            marks.append((max(0, a - 40) + s, max(0, a - 40) + e, good))
        if rare:
            if got := _two_byte(span, model):
                marks.append((a + got[0], a + got[1], got[2]))
                continue
        if BROKEN in span:
            marks.append((a, b, None))
    if not marks:
        return None
    marks = sorted(set(marks), key=lambda m: (m[0], -m[1]))
    out, at, wrong, left = [], 0, 0, 0
    for a, b, good in marks:
        if a < at:
            continue
        out += [text[at:a], text[a:b] if good is None else good]
        wrong += b - a
        left += b - a if good is None else good.count(BROKEN)
        at = b
    return "".join([*out, text[at:]]), wrong, left


def improbable_runs(blob: str, sizes: np.ndarray, model: Model) -> tuple[dict[int, list[tuple[int, int, bool]]], np.ndarray, np.ndarray]:
    """For texts one behind the other: the improbable runs of each that some reading may apply to (first character, end, whether rare)."""
    cp = codes(blob)
    ends = np.cumsum(sizes)
    runs: dict[int, list[tuple[int, int, bool]]] = {}
    if not len(cp):
        return runs, cp, ends
    s = model.scores(cp)
    edge = ends[(ends > 0) & (ends < len(cp))] - 1
    lead, cont = _masks()
    hits = (lead[cp[:-1]] & cont[cp[1:]]) != 0
    hits[edge] = False
    s[edge] = -1e6
    wide = (cp > 0x7F) & (cp != 0xFFFD)
    odd = _no_character(cp)
    notable = odd | (wide & (model.bits[cp] < RARE))
    near = hits.copy()  # a probable pair may end a run just before or behind
    near[1:] |= hits[:-1]
    near[:-1] |= hits[1:]
    alone = np.flatnonzero(sizes == 1)
    for o in alone[odd[ends[alone] - 1]].tolist():
        runs[o] = [(0, 1, False)]
    found = segments(s, near | notable[:-1] | notable[1:])
    if not found:
        return runs, cp, ends
    begin, end = np.array([a for a, _ in found]), np.array([b for _, b in found]) + 2  # pairs a..b are characters a..b+1
    # a run goes on as far as neighbours are of the same encodings' upper halves
    upper = ((lead[cp] | cont[cp]) != 0) & ((cp < 0x2E80) | (cp > 0x9FFF))
    stop = np.flatnonzero(~upper)
    lo = np.where(upper[begin], np.concatenate([[-1], stop])[np.searchsorted(stop, begin, "left")] + 1, begin)
    hi = np.where(upper[end - 1], np.append(stop, len(cp))[np.searchsorted(stop, end - 1, "left")], end)
    owner = np.searchsorted(ends, begin, "right")
    begin, end = np.maximum(lo, ends[owner] - sizes[owner]), np.minimum(hi, ends[owner])
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    within = lambda t: t[end] - t[begin]
    led = (t := total(hits))[end - 1] - t[begin] > 0
    n_wide = within(total(wide))
    rare = (n_wide >= 2) & (within(total(np.where(wide, model.bits[cp], 0.0))) < RARE * n_wide)
    for k in np.flatnonzero(led | rare | (within(total(odd)) > 0)).tolist():
        o = int(owner[k])
        base = int(ends[o] - sizes[o])
        own = runs.setdefault(o, [])
        if not own or own[-1][:2] != (int(begin[k]) - base, int(end[k]) - base):
            own.append((int(begin[k]) - base, int(end[k]) - base, bool(rare[k])))
    return runs, cp, ends


def repair_encoding(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Texts of which some part was read in a wrong encoding: ``id_col``, ``text_col`` as recorded, restored, wrong_chars, unrestored_chars.

    Character pairs of the whole corpus are counted exactly; pairs of little mutual information make up improbable runs (maximum-scoring segments); inside
    them inverse readings are tried: UTF-8 read in a one-byte encoding (once or twice), UTF-8, Big5 and GBK read in another
    two-byte one, swapped bytes of UTF-16, a symbol font's private code points.  A run with replacement characters that no
    reading restores counts as wrong and stays as it is.  Names, symbols, letters of other scripts and lone bullets are not touched.

    Null, empty and blank texts and texts in order give no row; repeated rows give one each; a null id stays null.  Only a table of fixed size
    (1 / SHOWN pairs at most, and code points) is sent to the workers, however many texts there are.
    """
    shared = df.sparkSession.sparkContext.broadcast(pair_counts(df, text_col))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            ids, at, texts, got = batch.column(0), [], [], []
            for first, end, blob, sizes in slices(batch.column(1)):
                runs, cp, ends = improbable_runs(blob, sizes, model)
                for k, own in runs.items():
                    a, b = int(ends[k] - sizes[k]), int(ends[k])
                    if (r := repair(blob[a:b], own, model, cp[a:b])) is not None:
                        at.append(first + k)
                        texts.append(blob[a:b])
                        got.append(r)
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(texts, pa.string()), *[pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]], names=["id", "text", "restored", "wrong_chars", "unrestored_chars"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(run, f"id {kind}, text string, restored string, wrong_chars int, unrestored_chars int")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "restored", "wrong_chars", "unrestored_chars")
