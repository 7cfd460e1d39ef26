"""Records that stand, exactly or almost, on both sides of a split: shared content-defined chunks summed into parts of either record."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from factlode.functions.keys import company_code, filing_id
from factlode.llm.bpe import codes
from factlode.llm.spans import common_prefix
from factlode.llm.winnow import mix
from factlode.runtime import materialise, width

#: A chunk ends where the hash of two neighbours is a multiple of this: so many characters on average.
CUT_EVERY = 2
#: Least part of either record that shared chunks must cover.
MIN_OVERLAP = 0.35
#: The most chunks that slips() can change in a record: three around a character too many, two where one is missing.
TOUCHED = 5
#: Placed records of a block (filing and page) beyond which its chunks are joined by Spark instead of in one task.
HOT_BLOCK = 2_000
#: Characters between two that are left out on different sides.
APART = 4
_DOUBLE = re.compile(r"(.)\1+")


def chunks(text: str, cut_every: int = CUT_EVERY) -> list[tuple[int, int]]:
    """Digest and length of each distinct content-defined chunk; a change of text moves only the cuts beside it."""
    if not text:
        return []
    cp = codes(text).astype(np.uint64)
    rolling = mix(cp[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[1:])
    ends = [*(np.flatnonzero(rolling % np.uint64(cut_every) == 0) + 1).tolist(), len(text)]
    return sorted({xxhash.xxh64_intdigest(text[i:j].encode()) - (1 << 63): j - i for i, j in zip([0, *ends], ends)}.items())


def chunk_overlaps(records: DataFrame, min_overlap: float = MIN_OVERLAP, cut_every: int = CUT_EVERY) -> DataFrame:
    """Pairs of records of different sides that share a block and enough text.

    records: rec (key), side (boolean), text (normalised), blocks (array of strings).  Gives rec_1 (side false), rec_2
    (side true), overlap_1 and overlap_2: the parts of either text that lie in chunks the other has too; the greater is at least ``min_overlap``.

    Chunk digests are joined within blocks.  A record offers its rarest chunks only, as many as it takes that a pair with
    enough overlap must meet in one of them; so phrases that most records have join nothing, and no pair is lost.
    Null or empty texts and records without blocks overlap nothing.
    """

    @F.pandas_udf("array<struct<digest:bigint,size:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"digest": a, "size": b} for a, b in chunks(t, cut_every)])

    r = records.where("text != '' and size(blocks) > 0").withColumn("chunks", cut("text")).select("rec", "side", "blocks", "chunks", F.aggregate("chunks", F.lit(0), lambda a, c: a + c.size).alias("chars"))
    r = materialise(r, "chunks")
    each = r.select("rec", "side", "chars", F.explode("chunks").alias("c")).select("rec", "side", "chars", "c.digest", "c.size")
    often = each.groupBy("digest").agg(F.count(F.lit(1)).alias("often"))
    rare = Window.partitionBy("rec").orderBy("often", "digest").rowsBetween(Window.unboundedPreceding, -1)
    # what stands before a chunk in the order of rarity may all be missing from a pair; beyond that limit the pair is too thin
    offered = each.join(often, "digest").withColumn("before", F.coalesce(F.sum("size").over(rare), F.lit(0))).where(F.col("before") <= F.col("chars") * (1 - min_overlap))
    keyed = offered.join(r.select("rec", "blocks"), "rec").select("rec", "side", "digest", F.explode("blocks").alias("block"))
    left = keyed.where("not side").select("block", "digest", F.col("rec").alias("rec_1"))
    right = keyed.where("side").select("block", "digest", F.col("rec").alias("rec_2"))
    pairs = left.join(right, ["block", "digest"]).select("rec_1", "rec_2").distinct()
    full = lambda n: r.select(F.col("rec").alias(f"rec_{n}"), F.col("chunks").alias(f"chunks_{n}"), F.col("chars").alias(f"chars_{n}"))
    pairs = pairs.join(full(1), "rec_1").join(full(2), "rec_2")
    both = F.aggregate(F.array_intersect("chunks_1", "chunks_2"), F.lit(0), lambda a, c: a + c.size)
    pairs = pairs.withColumn("both", both).select("rec_1", "rec_2", (F.col("both") / F.col("chars_1")).alias("overlap_1"), (F.col("both") / F.col("chars_2")).alias("overlap_2"))
    return pairs.where(F.greatest("overlap_1", "overlap_2") >= min_overlap)


#: Phrases around the matter of a question, which any typing may have or not.
PHRASES = ["根據財務報告", "依年報所載", "與其關係企業", "主要原因", "四捨五入", "請附單位", "請說明", "是什麼", "請問"]
#: Characters of the wording that carry no matter.
WORDING = set("的之在於與及各為何是多少分別說明揭露金額請問什麼差異比率其")
#: Spellings of one character.
SAME = str.maketrans("佔臺仟", "占台千")
_PERIOD = re.compile(r"(?:民國|西元)?([0-9]{2,4})年度?(?:第?([一二三四1-4])季度?)?|FY([0-9]{4})(?:年度?)?(?:Q([1-4]))?")
_QUARTER = {"一": "1", "二": "2", "三": "3", "四": "4"}


def _typed(phrase: str) -> str:
    """A pattern for a phrase with at most one character left out or typed twice."""
    forms = {phrase} | {phrase[:i] + phrase[i + 1 :] for i in range(len(phrase))} | {phrase[:i] + phrase[i] + phrase[i:] for i in range(len(phrase))}
    return "|".join(sorted(forms, key=lambda f: (-len(f), f)))


_PHRASE = re.compile("|".join(_typed(p) for p in sorted(PHRASES, key=len, reverse=True) if len(p) > 2))


def normal_question(text: str | None) -> tuple[str, tuple[str, ...]]:
    """The matter of a question and its periods (``2022``, ``2022Q3``; years of the republic counted from 1911)."""
    t = re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or "")).translate(SAME)
    periods = set()

    def period(m: re.Match) -> str:
        year = int(m[1] or m[3])
        quarter = _QUARTER.get(m[2], m[2]) or m[4]
        periods.add(f"{year + 1911 if year < 1000 else year}" + (f"Q{quarter}" if quarter else ""))
        return ""

    t = _PHRASE.sub("", _PERIOD.sub(period, t))
    return "".join(c for c in t if c not in WORDING and unicodedata.category(c)[0] in "LN"), tuple(sorted(periods))


def _single(text: str) -> str:
    """Without characters typed twice."""
    return _DOUBLE.sub(r"\1", text)


def slips(a: str, b: str) -> bool:
    """Whether two typings differ only by characters typed twice and, on either side, one left out.

    Two that are left out on different sides must lie APART characters from each other; nearer, one stands in the other's place.
    """
    a, b = _single(a), _single(b)
    if a == b:
        return True
    i = common_prefix(a, b)
    a, b = a[i:], b[i:]
    j = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return len(a) + len(b) == 1
    return len(a) == len(b) > APART and (a[1:] == b[:-1] or a[:-1] == b[1:])


def slip_keys(text: str) -> list[int]:
    """Digests of a text without its doublings, as it is and with each character left out: two that slips() takes for one have a digest in common."""
    t = _single(text)
    return sorted({xxhash.xxh64_intdigest(f.encode()) - (1 << 63) for f in (t, *(t[:i] + t[i + 1 :] for i in range(len(t))))})


def slip_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records of different sides that share a block and a slip key: rec_1 (side false), rec_2 (side true).

    records: as for chunk_overlaps.  No pair that slips() accepts is missing; others may be among them.
    Null or empty texts and records without blocks pair with nothing.
    """

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(slip_keys)

    r = records.where("text != '' and size(blocks) > 0")
    placed = r.select("rec", "side", "text", F.explode("blocks").alias("block"))
    # keys are made only where a block has both sides
    mixed = placed.groupBy("block").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low != high").select("block")
    keyed = placed.join(mixed, "block").select("rec", "side", "block", F.explode(keys("text")).alias("digest"))
    left = keyed.where("not side").select("block", "digest", F.col("rec").alias("rec_1"))
    right = keyed.where("side").select("block", "digest", F.col("rec").alias("rec_2"))
    return left.join(right, ["block", "digest"]).select("rec_1", "rec_2").distinct()


def same_question(text_1: str, said_1: tuple[str, ...], period_1: str | None, code_1: str | None, text_2: str, said_2: tuple[str, ...], period_2: str | None, code_2: str | None) -> bool:
    """The exact check behind the keys: same company, periods and matter, slips of typing aside."""
    if code_1 and code_2 and code_1 != code_2:
        return False
    if period_1 and period_2 and period_1 != period_2:
        return False
    if said_1 != said_2 and not (period_1 and period_1 == period_2 and (len(said_1) != len(said_2) or not said_1)):
        return False
    return slips(text_1, text_2)


def _normal_period(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), r"(?U)\s+", ""), F.lit(""))


def thin(cut: list[tuple[int, int]], min_overlap: float = MIN_OVERLAP) -> bool:
    """Whether slips may leave a record with less than ``min_overlap`` in shared chunks, because its longest chunks hold the rest."""
    sizes = sorted((n for _, n in cut), reverse=True)
    return sum(sizes[TOUCHED:]) < min_overlap * sum(sizes)


def overlaps_within(left: list[str], right: list[str]) -> dict[tuple[int, int], float]:
    """Of normalised texts on two sides, the pairs worth an exact check, by place, with the greater part of either that shared chunks cover.

    Chunk digests of both sides meet and the lengths of shared ones are summed.  Pairs of which some part reaches MIN_OVERLAP come out, and, as slips() may
    leave less where both are thin, thin ones that share a slip key: no pair that slips() accepts is missing.
    """
    cut = [[chunks(_single(t)) for t in side] for side in (left, right)]
    at = defaultdict(list)
    for i, c in enumerate(cut[0]):
        for d, _ in c:
            at[d].append(i)
    total = [[sum(n for _, n in c) for c in side] for side in cut]
    out = {}
    for j, c in enumerate(cut[1]):
        both: Counter[int] = Counter()
        for d, n in c:
            for i in at.get(d, ()):
                both[i] += n
        for i, n in both.items():
            part = n / min(total[0][i], total[1][j])
            if part >= MIN_OVERLAP or (thin(cut[0][i]) and thin(c)):
                out[i, j] = part
    keys = defaultdict(list)
    for i, t in enumerate(left):
        if thin(cut[0][i]):
            for k in slip_keys(t):
                keys[k].append(i)
    for j, t in enumerate(right):
        if keys and thin(cut[1][j]):
            for k in slip_keys(t):
                for i in keys.get(k, ()):
                    out.setdefault((i, j), 0.0)
    return out


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of question ids within whole blocks, of rows (block, id, side, question, code, period) in order of block."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key = t.column("block").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        side = t.column("side").to_numpy(zero_copy_only=False).astype(bool)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        mixed = np.logical_or.reduceat(side, first) & ~np.logical_and.reduceat(side, first)
        size = np.diff(np.append(first, len(key)))
        took = np.flatnonzero(np.repeat(mixed, size))
        ids, texts, codes_, periods = (t.column(c).take(pa.array(took)).to_pylist() for c in ("id", "question", "code", "period"))
        normal = {q: normal_question(q) for q in set(texts)}
        blocks: dict[int, list[dict]] = {}
        for b, s, i, q, c, p in zip(key[took].tolist(), side[took].tolist(), ids, texts, codes_, periods):
            text, said = normal[q]
            if text:
                blocks.setdefault(b, [{}, {}])[s].setdefault((text, tuple(said), p, c), set()).add(i)
        found = []
        for left, right in blocks.values():
            one, two = list(left), list(right)
            for (i, j), part in overlaps_within([r[0] for r in one], [r[0] for r in two]).items():
                if same_question(*one[i], *two[j]):
                    found += [(x, y, part) for x in left[one[i]] for y in right[two[j]]]
        kind = t.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.float64())], names=["i", "j", "overlap"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 20_000:
            continue
        key = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1])
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pairs(pa.Table.from_batches(held))


def question_overlaps(gold: DataFrame, training: tuple[str, ...] = ("dev", "challenger"), hot_block: int = HOT_BLOCK) -> DataFrame:
    """Questions of the evaluation sets that the training sets ask too: question_id_1 < question_id_2, overlap.

    gold: question_id, question_set, question, company.code, period, source_document, page_numbers.  Sets not named in ``training`` are
    evaluation sets.  Two questions are one if they cite a filing in common and share a page number, and company, periods and
    matter agree however they are worded or typed; overlap is the part of either that content-defined chunks cover, of any size.
    Rows without an id, set, question, filing or page overlap nothing; an unknown code or period agrees with any.
    Repeated rows and equal questions are compared once and come out as all their pairs.

    Questions meet by filing and page: those of a block in one task, where nothing but blocks with both sides is normalised; blocks of more than
    ``hot_block`` placed questions by joins of their rarest chunks.
    """
    filings = F.array_distinct(F.filter(F.transform(F.coalesce("source_document", F.array().cast("array<string>")), filing_id), lambda x: x.isNotNull()))
    pages = F.array_distinct(F.filter(F.coalesce("page_numbers", F.array().cast("array<int>")), lambda x: x.isNotNull()))
    blocks = F.flatten(F.transform(filings, lambda f: F.transform(pages, lambda p: F.concat(f, F.lit("#"), p.cast("string")))))
    rows = gold.select("question_id", (~F.col("question_set").isin(*training)).alias("side"), "question", F.col("company.code").alias("code"), "period", blocks.alias("blocks")).where("question_id is not null and side is not null and question is not null")
    placed = rows.select(F.explode("blocks").alias("block"), F.col("question_id").alias("id"), "side", "question", "code", "period")
    hot = materialise(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_block).select("block"), "hot")
    some_hot = not hot.isEmpty()
    usual = placed.join(hot, "block", "left_anti") if some_hot else placed
    usual = usual.select("block", "id", "side", "question", company_code(F.col("code")).alias("code"), _normal_period(F.col("period")).alias("period"))
    kind = placed.schema["id"].dataType.simpleString()
    out = usual.repartition(width(gold.sparkSession), "block").sortWithinPartitions("block").mapInArrow(_block_pairs, f"i {kind}, j {kind}, overlap double")
    if some_hot:
        out = out.unionByName(_hot_overlaps(placed.join(hot, "block", "left_semi")))
    return out.where("i != j").groupBy(F.least("i", "j").alias("question_id_1"), F.greatest("i", "j").alias("question_id_2")).agg(F.max("overlap").alias("overlap"))


def _hot_overlaps(placed: DataFrame) -> DataFrame:
    """The same for blocks too large for one task: i, j, overlap of questions that share one of ``placed`` (block, id, side, question, code, period)."""

    @F.pandas_udf("struct<text:string,said:array<string>>")
    def normal(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normal_question(t) for t in texts], columns=["text", "said"])

    @F.pandas_udf("boolean")
    def one(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([same_question(t1, tuple(s1), p1, c1, t2, tuple(s2), p2, c2) for t1, s1, p1, c1, t2, s2, p2, c2 in zip(a, b, c, d, e, f, g, h)], dtype=bool)

    @F.pandas_udf("boolean")
    def is_thin(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: thin(chunks(_single(t)))).astype(bool)

    @F.pandas_udf("string")
    def single(texts: pd.Series) -> pd.Series:
        return texts.map(_single)

    rows = placed.groupBy("id", "side", "question", "code", "period").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    rows = rows.select("id", "side", normal(F.col("question")).alias("n"), company_code(F.col("code")).alias("code"), _normal_period(F.col("period")).alias("period"), "blocks").select("id", "side", "n.text", "n.said", "code", "period", "blocks")
    key = F.unhex(F.md5(F.to_json(F.struct("side", "text", "said", "code", "period", "blocks"))))
    rows = materialise(rows.withColumn("rec", key), "questions")
    once = rows.drop("id").dropDuplicates(["rec"])
    near = chunk_overlaps(once.select("rec", "side", single("text").alias("text"), "blocks")).select("rec_1", "rec_2", F.greatest("overlap_1", "overlap_2").alias("overlap"))
    few = slip_pairs(once.where(F.col("text") != "").where(is_thin("text")).select("rec", "side", "text", "blocks")).withColumn("overlap", F.lit(0.0))
    near = near.unionAll(few).groupBy("rec_1", "rec_2").agg(F.max("overlap").alias("overlap"))
    cols = ["text", "said", "period", "code"]
    full = lambda n: once.select(F.col("rec").alias(f"rec_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in cols])
    near = near.join(full(1), "rec_1").join(full(2), "rec_2").where(one(*[F.col(f"{c}_{n}") for n in (1, 2) for c in cols])).select("rec_1", "rec_2", "overlap")
    ids = rows.select("rec", "id").distinct()
    return near.join(ids.select(F.col("rec").alias("rec_1"), F.col("id").alias("i")), "rec_1").join(ids.select(F.col("rec").alias("rec_2"), F.col("id").alias("j")), "rec_2").select("i", "j", "overlap")
