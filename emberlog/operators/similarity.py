"""Similar digests: perceptual hashes by Hamming distance, context-triggered hashes by score."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from emberlog.operators.common import explode_rows
from emberlog.session import ship

#: Blocks that rows are dealt to at least. A task holds two, and each row goes to as many tasks as there are blocks.
BLOCKS = 16


def _every_pair(left: DataFrame, right: DataFrame | None, judge, kind: str) -> DataFrame:
    """What `judge` finds in all pairs of a row of `left` and one of `right`, or of two rows of `left`.

    Rows are dealt to blocks by the hash of their first column, and each two blocks make one task, so every pair meets once,
    tasks are alike whatever the rows hold, and nothing is broadcast. `judge` gets both blocks as Arrow
    tables, the second as None where a block meets itself, and yields batches of the columns of `kind`.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    spark = left.sparkSession
    ship(spark)
    n = max(BLOCKS, math.isqrt(8 * spark.sparkContext.defaultParallelism))
    own, other = F.col("_own"), F.col("_other")

    def copies(df):
        return df.withColumn("_own", F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if right is None:
        high = F.greatest(own, other)
        rows = copies(left).select(*left.columns, F.when(own < other, "left").when(own > other, "right").otherwise(
            "both").alias("_side"), (F.shiftright(high * (high + 1), 1) + F.least(own, other)).alias("_task"))
        tasks = n * (n + 1) // 2
    else:
        rows = copies(left).select(*left.columns, F.lit("left").alias("_side"), (own * n + other).alias("_task")
                                   ).unionByName(copies(right).select(*right.columns, F.lit("right").alias(
                                       "_side"), (other * n + own).alias("_task")))
        tasks = n * n

    def work(batches):
        sides = {"left": [], "right": [], "both": []}
        for batch in batches:
            side = batch.column("_side").dictionary_encode()
            for code, name in enumerate(side.dictionary.to_pylist()):
                sides[name].append(batch.drop_columns(["_side", "_task"]).filter(pc.equal(side.indices, code)))
        tables = {name: pa.Table.from_batches(found) for name, found in sides.items() if found}
        if "both" in tables:
            yield from judge(tables["both"], None)
        elif "left" in tables and "right" in tables:
            yield from judge(tables["left"], tables["right"])

    return rows.repartitionById(tasks, F.col("_task")).mapInArrow(work, kind)


#: Pairs of a task that are handed on at once.
PAIRS = 100_000


def _batches(found, left, right, keep, value: str = "distance"):
    """Arrow batches of found pairs: (row of left, rows of right, their values), each for one row of left.

    Rows are given as the values of the columns `keep`, with _a and _b after their names.
    """
    import pyarrow as pa

    def batch(some):
        sizes = [len(j) for _, j, _ in some]
        at = {"a": (left, np.repeat([i for i, _, _ in some], sizes)), "b": (right, np.concatenate([j for _, j, _ in some]))}
        columns = {f"{c}_{side}": table[c].take(pa.array(rows)).combine_chunks()
                   for c in keep for side, (table, rows) in at.items()}
        columns[value] = pa.array(np.concatenate([d for _, _, d in some]).astype("int32"))
        return pa.RecordBatch.from_pydict(columns)
    some, held = [], 0
    for one in found:
        some.append(one)
        held += len(one[1])
        if held >= PAIRS:
            yield batch(some)
            some, held = [], 0
    if some:
        yield batch(some)


def hash_neighbours(digests: DataFrame, other: DataFrame | None = None, max_distance: int = 8,
                    column: str = "phash", carry: str | None = None) -> DataFrame:
    """Pairs of distinct 64-bit hashes within a Hamming distance of at most 11; exact.

    Only distinct hashes take part: copies of one file add nothing here and come back through a join
    on the hash, or, where `digests` has a row per hash, with the BIGINT column `carry` of both.
    All pairs are compared, a block with a block: hashes of few set bits share most values of a band of
    bits, and then to look up each band's neighbours makes more candidates than there are pairs.
    """
    if max_distance >= 12:
        raise ValueError("max_distance must be below 12")

    def hashes(df):
        h = df.select(F.lower(F.col(column)).alias("hash"), *([F.col(carry).alias("n")] if carry else [])).filter(
            F.col("hash").rlike("^[0-9a-f]{16}$"))
        high, low = (F.conv(F.substring("hash", i, 8), 16, 10).cast("bigint") for i in (1, 9))
        return (h if carry else h.distinct()).withColumn("bits", F.shiftleft(high, 32).bitwiseOR(low))

    def judge(left, right):
        a = left["bits"].to_numpy().view("uint64")
        b = a if right is None else right["bits"].to_numpy().view("uint64")

        def found():
            for i, bits in enumerate(a):
                start = i + 1 if right is None else 0
                distance = np.bitwise_count(b[start:] ^ bits)
                if len(near := np.flatnonzero(distance <= max_distance)):
                    yield i, near + start, distance[near]
        yield from _batches(found(), left, left if right is None else right, ["hash"] + ["n"] * bool(carry))

    pairs = _every_pair(hashes(digests), None if other is None else hashes(other), judge, "hash_a string, hash_b string, "
                        + "n_a bigint, n_b bigint, " * bool(carry) + "distance int")
    a, b = "hash_a", "hash_b"
    if other is None:  # which of the two comes first is decided by the hash
        turned = F.col("hash_a") > F.col("hash_b")
        a, b = F.least("hash_a", "hash_b").alias("hash_a"), F.greatest("hash_a", "hash_b").alias("hash_b")
    else:
        turned = F.lit(False)
    carried = [F.when(turned, y).otherwise(F.col(x)).alias(f"{carry}_{x[-1]}")
               for x, y in (("n_a", F.col("n_b")), ("n_b", F.col("n_a")))] if carry else []
    return pairs.select(a, b, "distance", *carried)


def near_identical(files: DataFrame, max_distance: int = 8) -> DataFrame:
    """Pairs of near-identical hashes with the number of distinct contents on each side.

    Columns phash, sha256. A hash held by several contents is reported as a pair with itself.
    """
    held = files.select(F.lower("phash").alias("phash"), "sha256").distinct().groupBy(
        "phash").agg(F.count("*").alias("contents"))
    pairs = hash_neighbours(held, max_distance=max_distance, carry="contents")
    same = held.filter(F.col("contents") > 1).select(
        F.col("phash").alias("hash_a"), F.col("phash").alias("hash_b"), F.lit(0).alias("distance"),
        F.col("contents").alias("contents_a"), F.col("contents").alias("contents_b"))
    return pairs.select("hash_b", "hash_a", "distance", "contents_a", "contents_b").unionByName(same)


def similar_across_cases(digests: DataFrame, max_distance: int = 8) -> DataFrame:
    """For every case and hash: similar hashes known from other cases, closest first by distance.

    Columns case_id, phash. The other side is given as its number of other cases, not as pairs of
    cases.
    """
    own = digests.select("case_id", F.lower("phash").alias("hash")).distinct()
    cases = own.groupBy("hash").agg(F.count("*").alias("_cases"))
    near = hash_neighbours(cases, max_distance=max_distance, column="hash", carry="_cases")
    ways = [F.struct(F.col(x).alias("hash"), F.col(y).alias("similar"), "distance", F.col(n).alias("_cases"))
            for x, y, n in (("hash_a", "hash_b", "_cases_b"), ("hash_b", "hash_a", "_cases_a"))]
    known = near.select(F.explode(F.array(*ways)).alias("_way")).select("_way.*").union(
        cases.select("hash", "hash", F.lit(0), "_cases")).hint("merge")  # Spark expects far fewer rows of pairs
    held = own.select(F.col("hash").alias("similar"), "case_id", F.lit(1).alias("_own"))
    return own.join(known, "hash").hint("merge").join(held, ["similar", "case_id"], "left").withColumn(
        "other_cases", F.col("_cases") - F.coalesce("_own", F.lit(0))).filter(
        F.col("other_cases") > 0).select("case_id", "hash", "similar", "distance", "other_cases")


# --- context-triggered hashes ------------------------------------------------------------------

_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Low six bits of a 32-bit FNV hash after the next byte, both times 64; the others never reach them.
_NEXT = [((state * 0x13 ^ c) & 63) << 6 for state in range(64) for c in range(64)]


#: Bytes of texts digested at once; fewer pieces than this are hashed one by one.
TOGETHER, FEW = 1 << 21, 48


def _rolling(data) -> np.ndarray:
    """The rolling hash of seven bytes at each place but the first six."""
    out = np.empty(len(data) - 6, dtype=np.uint32)
    for at in range(0, len(out), 1 << 15):  # pieces that stay in the processor's cache
        c = data[at:at + (1 << 15) + 6].astype(np.uint32)
        n = len(c) - 6
        roll, shifted = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
        for back in range(7):
            x = c[6 - back:6 - back + n]
            roll += x * np.uint32(8 - back)  # the sum and the weighted sum of the window
            shifted ^= x << np.uint32(5 * back)
        out[at:at + n] = roll + shifted
    return out


def _piece_hashes(low: bytes, starts, ends) -> np.ndarray:
    """Six bits of the hash of every piece; all pieces take a byte at a time, the longest ones to the end."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], np.sort(sizes)
    data, step = np.frombuffer(low, dtype=np.uint8), np.array(_NEXT, dtype=np.uint16)
    state = np.full(len(at), 0x27 << 6, dtype=np.uint16)
    done = 0
    while (active := len(at) - int(np.searchsorted(left, done, "right"))) >= FEW:
        state[:active] = step[state[:active] | data[at[:active] + done]]
        done += 1
    for i in range(active):
        one, begin = int(state[i]), int(at[i])
        for b in low[begin + done:begin + int(sizes[order[i]])]:
            one = _NEXT[one | b]
        state[i] = one
    out = np.empty(len(at), dtype=np.uint8)
    out[order] = state >> 6
    return out


def _digests(some: list[bytes]) -> list[str]:
    joined = bytes(6) + bytes(6).join(some)  # no window reaches into another text
    rolls = _rolling(np.frombuffer(joined, dtype=np.uint8)) if len(joined) > 6 else np.zeros(0, dtype=np.uint32)
    low = joined.translate(bytes(b & 63 for b in range(256)))
    starts, ends, texts, begin = [], [], [], 0
    for data in some:
        n = len(data)
        roll = rolls[begin:begin + n]
        # 2 modulo 3, by the inverse of 3 modulo 2 ** 32
        third = np.flatnonzero((roll - np.uint32(2)) * np.uint32(0xAAAAAAAB) < np.uint32(0x55555555))
        value = roll[third]

        def places(block: int) -> np.ndarray:  # of block - 1 modulo block, which is 3 times a power of two
            ones = np.uint32(block // 3 - 1)
            return third[value & ones == ones]

        block = 3
        while block * 64 < n:
            block *= 2
        while block > 3 and len(places(block)) + (roll[-1] != 0) < 32:
            block //= 2
        counts = []
        for size, most in ((block, 64), (block * 2, 32)) if n else ():
            found = places(size)
            cut = found[:most - 1] + 1
            starts.append(np.concatenate([[0], cut]) + begin + 6)
            ends.append(np.concatenate([cut, [n]]) + begin + 6)
            # as the original, which then adds no last piece
            counts.append((len(cut) + 1, int(roll[-1] == 0 and len(found) < most)))
        texts.append((block, counts))
        begin += n + 6
    if starts:
        found = _piece_hashes(low, np.concatenate(starts), np.concatenate(ends))
        letters = np.frombuffer(_BASE64.encode(), dtype=np.uint8)[found].tobytes().decode()
    out, at = [], 0
    for block, counts in texts:
        parts = []
        for n, dropped in counts:
            parts.append(letters[at:at + n - dropped])
            at += n
        out.append(f"{block}:{':'.join(parts or ['', ''])}")
    return out


def fuzzy_digest(data: bytes) -> str:
    """Context-triggered piecewise hash (ssdeep) of all bytes: block size, and signatures at it and its double.

    A rolling hash of seven bytes ends the pieces, so an edit changes only the piece it is in. The block
    size is 3 times a power of two, by length, and halved until there are 32 pieces.
    """
    return _digests([data])[0]


def _text_digests(texts) -> list[str | None]:
    out, some, held = [], [], 0

    def digested():
        found = iter(_digests([x for x in some if x is not None]))
        return [None if x is None else next(found) for x in some]
    for data in texts:
        if held + len(data or b"") > TOGETHER:
            out += digested()
            some, held = [], 0
        some.append(data)
        held += len(data or b"")
    return out + digested()


def fuzzy_digests(texts: DataFrame, text: str = "text") -> DataFrame:
    """ssdeep of every text, read whole; null texts have none."""
    import pyarrow as pa
    ship(texts.sparkSession)

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ssdeep": pa.array(_text_digests(batch.column(0).to_pylist()), pa.string())})

    # no function of a column, as a filter on its result would call it a second time
    return texts.select(F.col(text).cast("binary").alias("_text")).mapInArrow(work, "ssdeep string")


def _edit_cost(a: str, b: str) -> int:
    """Insert and delete cost one, replace costs two: both lengths minus twice the common part.

    The longest common subsequence is counted on the bits of one integer.
    """
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _squeeze(s: str) -> str:
    """Runs of more than three equal characters cut to three."""
    out = []
    for ch in s:
        if out[-3:] != [ch] * 3:
            out.append(ch)
    return "".join(out)


def _part_score(a: str, b: str, block: int) -> int:
    if not any(a[i:i + 7] in b for i in range(len(a) - 6)):
        return 0
    score = 100 - 100 * (_edit_cost(a, b) * 64 // (len(a) + len(b))) // 64
    return min(score, block // 3 * min(len(a), len(b)))


def _parsed(h: str) -> tuple[int, str, str]:
    block, x, y = h.split(":", 2)
    return int(block), _squeeze(x), _squeeze(y.split(",")[0])


def _score(x: tuple[int, str, str], y: tuple[int, str, str]) -> int:
    (bx, x1, x2), (by, y1, y2) = x, y
    if bx == by:
        if (x1, x2) == (y1, y2):
            return 100
        return max(_part_score(x1, y1, bx), _part_score(x2, y2, bx * 2))
    if bx == by * 2:
        return _part_score(x1, y2, bx)
    return _part_score(x2, y1, by) if by == bx * 2 else 0


@F.pandas_udf(T.IntegerType())
def _fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_score(_parsed(x), _parsed(y)) for x, y in zip(a, b)], dtype="int32")


class _Signatures:
    """Digests of a block, ready to be scored by thousands: of both parts the letters, lengths and places.

    A digest with a part of more than 64 characters or with others than base64 has is not `plain`.
    """

    def __init__(self, digests: list[str]) -> None:
        self.parsed = [_parsed(h) for h in digests]
        size = len(digests)
        self.plain = np.array([len(x) <= 64 and len(y) <= 64 and block < 1 << 40 and not {*x, *y} - {*_BASE64}
                               for block, x, y in self.parsed], dtype=bool)
        self.block = np.array([p[0] if ok else -1 for p, ok in zip(self.parsed, self.plain)], dtype=np.int64)
        code = np.full(256, 64, dtype=np.uint8)
        code[np.frombuffer(_BASE64.encode(), dtype=np.uint8)] = np.arange(64)
        self.letters, self.length = [], []
        for part in (1, 2):
            texts = [p[part] if ok else "" for p, ok in zip(self.parsed, self.plain)]
            raw = "".join(t.ljust(64) for t in texts).encode()
            self.letters.append(code[np.frombuffer(raw, dtype=np.uint8)].reshape(size, 64))
            self.length.append(np.array([len(t) for t in texts], dtype=np.int64))

    def places(self, part: int) -> np.ndarray:
        """For each digest and letter the places of the letter, as bits; none for the filling."""
        found = np.zeros((len(self.parsed), 65), dtype=np.uint64)
        rows = np.arange(len(self.parsed))
        for i in range(64):
            found[rows, self.letters[part][:, i]] |= np.uint64(1 << i)
        found[:, 64] = 0
        return found


def _part_scores(a: _Signatures, i, part_a: int, masks, b: _Signatures, j, part_b: int, block):
    """`_part_score` of the parts of digests i of a and j of b, all at once on 64-bit rows."""
    la, lb = a.length[part_a][i], b.length[part_b][j]
    letters = b.letters[part_b][j]
    row = np.full(len(i), (1 << 64) - 1, dtype=np.uint64)
    common = np.zeros(len(i), dtype=bool)
    one, two, three = np.uint64(1), np.uint64(2), np.uint64(3)
    last = np.zeros(len(i), dtype=np.uint64)
    pairs, fours = [last] * 2, [last] * 3  # runs of two and of four that ended one to three places before
    for k in range(int(lb.max(initial=0))):
        mask = masks[i, letters[:, k]]
        pair = mask & (last << one)
        four = pair & (pairs[0] << two)
        common |= (four & (fours[0] << three)) != 0
        pairs, fours, last = [pairs[1], pair], [*fours[1:], four], mask
        hit = row & mask
        row = (row + hit) | (row - hit)
    full = (np.uint64(1) << la.astype(np.uint64) % np.uint64(64)) - one
    full[la == 64] = (1 << 64) - 1
    both = la + lb
    cost = both - 2 * (la - np.bitwise_count(row & full).astype(np.int64))
    score = 100 - 100 * (cost * 64 // np.maximum(both, 1)) // 64
    return np.where(common, np.minimum(score, block // 3 * np.minimum(la, lb)), 0)


#: Meetings of two digests in a run of seven that are looked at together.
MEETINGS = 1 << 20


def _meetings(left, right):
    """Pairs of rows of two tables that share a key: rows of left and of right, each pair once; in pieces.

    Without `right`, pairs of a row with a later one of `left`.
    """
    def flat(table):
        keys = table["keys"].combine_chunks()
        rows = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
        return keys.flatten().to_numpy(), rows
    key, row = flat(left)
    other, at = (key, row) if right is None else flat(right)
    order = np.argsort(other, kind="stable")
    other, at = other[order], at[order]
    first, last = np.searchsorted(other, key, "left"), np.searchsorted(other, key, "right")
    sizes = last - first
    # cuts between rows, after about as many meetings
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    width = int(at.max(initial=0)) + 1
    while begin < len(row):
        cut = ends[max(np.searchsorted(total[ends], total[begin] + MEETINGS, "right") - 1, np.searchsorted(ends, begin, "right"))]
        n = sizes[begin:cut]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[begin:cut], n)
        mine, theirs = np.repeat(row[begin:cut], n), at[places]
        if right is None:
            later = theirs > mine
            mine, theirs = mine[later], theirs[later]
        pairs = np.unique(mine * width + theirs)
        if len(pairs):
            yield pairs // width, pairs % width
        begin = cut


def _scored(left, right, min_score: int):
    """Pairs of digests of two blocks that share a key and score enough, as for `_batches`."""
    a = _Signatures(left["h"].to_pylist())
    b = a if right is None else _Signatures(right["h"].to_pylist())
    masks = [a.places(0), a.places(1)]
    for i, j in _meetings(left, right):
        score = np.zeros(len(i), dtype=np.int64)
        bi, bj = a.block[i], b.block[j]
        plain = a.plain[i] & b.plain[j]
        for at, parts in ((bi == bj, ((0, 0), (1, 1))), (bi == bj * 2, ((0, 1),)), (bj == bi * 2, ((1, 0),))):
            at = np.flatnonzero(at & plain)
            for x, y in parts if len(at) else ():
                score[at] = np.maximum(score[at], _part_scores(a, i[at], x, masks[x], b, j[at], y, bi[at] << x))
            if len(parts) == 2 and len(at):
                same = np.logical_and.reduce([(a.letters[x][i[at]] == b.letters[x][j[at]]).all(axis=1) for x in (0, 1)])
                score[at[same]] = 100
        for k in np.flatnonzero(~plain):
            score[k] = _score(a.parsed[i[k]], b.parsed[j[k]])
        kept = np.flatnonzero(score >= min_score)
        starts = np.flatnonzero(np.diff(i[kept], prepend=-1))
        for rows in np.split(kept, starts[1:]) if len(kept) else ():
            yield int(i[rows[0]]), j[rows], score[rows]


def fuzzy_neighbours(digests: DataFrame, min_score: int = 20, column: str = "ssdeep") -> DataFrame:
    """Pairs of distinct context-triggered hashes that score at least `min_score`.

    A score above zero needs a common run of seven characters at one block size, so candidates are
    the pairs that share (block size, seven characters); the rest cannot score. Most runs are in one
    hash only; the others go with their hash, as numbers, and blocks of hashes are held against each
    other, so that a run which many hashes share makes its pairs in all tasks.
    """
    h = digests.select(F.col(column).alias("h")).filter(
        F.col("h").rlike(r"^[0-9]+:[^:]*:[^:]*$")).distinct()
    parts = F.split("h", ":")
    block = parts[0].cast("bigint")

    def grams(s, size):
        s = F.regexp_replace(s, r"(.)\1{3,}", "$1$1$1")
        return F.when(F.length(s) >= 7, F.transform(
            F.sequence(F.lit(1), F.length(s) - 6), lambda i: F.xxhash64(
                size, F.substr(s, i, F.lit(7))))).otherwise(F.array().cast("array<bigint>"))
    id_ = F.xxhash64("h")
    keyed = explode_rows(h.withColumn("_id", id_), F.array_distinct(F.concat(
        grams(parts[1], block), grams(F.split(parts[2], ",")[0], block * 2))), "_key", "_id")
    shared = keyed.withColumn("_n", F.count("*").over(W.partitionBy("_key"))).filter(F.col("_n") > 1).groupBy(
        "_id").agg(F.collect_list("_key").alias("keys"))
    # Spark expects one row for each list of keys, so it is not to broadcast them
    some = h.withColumn("_id", id_).join(shared.hint("merge"), "_id").select("h", "keys")
    pairs = _every_pair(some, None, lambda left, right: _batches(
        _scored(left, right, min_score), left, left if right is None else right, ["h"], "score"),
        "h_a string, h_b string, score int")
    return pairs.select(F.least("h_a", "h_b").alias("hash_a"), F.greatest("h_a", "h_b").alias("hash_b"), "score")


# --- locality-sensitive hashes ---------------------------------------------------------------------

def _ring(size: int) -> np.ndarray:
    """Steps on a ring of so many values, by the difference."""
    step = np.arange(size)
    return np.minimum(step, size - step)


def _header_costs() -> tuple[np.ndarray, np.ndarray]:
    """Cost of two length bytes by their difference, and of two bytes of quartile ratios by both."""
    step = _ring(256)
    length = np.where(step <= 1, step, step * 12).astype(np.int16)
    nibble = _ring(16)
    nibble = np.where(nibble <= 1, nibble, (nibble - 1) * 12)
    x, y = np.arange(256)[:, None], np.arange(256)[None, :]
    return length, (nibble[(x >> 4) - (y >> 4) & 15] + nibble[x - y & 15]).astype(np.int16)


class _Locality:
    """Locality hashes of a block: header bytes, and the 128 codes of the bodies as three planes of bits.

    Of codes 0 to 3 the planes tell which are at least 1, 2 and 3, so two codes differ in as many planes as they lie apart.
    """

    def __init__(self, table) -> None:
        raw = np.frombuffer(b"".join(table["raw"].to_pylist()), dtype=np.uint8).reshape(-1, 35)
        self.check, self.length, self.ratios = raw[:, 0], (raw[:, 1] >> 4) | (raw[:, 1] << 4), raw[:, 2]
        words = np.ascontiguousarray(raw[:, 3:]).view(np.uint64).T
        odd = np.uint64(0x5555555555555555)
        high, low = (words >> np.uint64(1)) & odd, words & odd
        high, low = (x[:2] | (x[2:] << np.uint64(1)) for x in (high, low))
        self.planes = np.concatenate([high | low, high, high & low])


def _near_locality(left, right, max_distance: int):
    """Rows of `right` within a distance of each row of `left`, as for `_batches`."""
    a, b = _Locality(left), _Locality(right)
    length_cost, ratio_cost = _header_costs()
    order = np.argsort(b.length, kind="stable")
    check, length, ratios, planes = b.check[order], b.length[order], b.ratios[order], np.ascontiguousarray(b.planes[:, order])
    begin = np.searchsorted(length, np.arange(257))
    reach = min(max(max_distance // 12, 1), 128)
    for i in range(len(a.check)):
        low, high = int(a.length[i]) - reach, int(a.length[i]) + reach + 1
        if high - low >= 256:
            spans = [(0, 256)]
        else:  # the length byte goes round
            spans = [(max(low, 0), min(high, 256)), (low + 256, 256), (0, high - 256)]
        rows, distances = [], []
        for x, y in spans:
            if x >= y or begin[x] == begin[y]:
                continue
            at = slice(begin[x], begin[y])
            head = length_cost[length[at] - a.length[i]] + ratio_cost[a.ratios[i]][ratios[at]] + (check[at] != a.check[i])
            near = np.flatnonzero(head <= max_distance)
            if len(near) == 0:
                continue
            body = (planes[:, at] if len(near) == len(head) else planes[:, near + begin[x]]) ^ a.planes[:, i:i + 1]
            n = np.bitwise_count(body)
            three = np.bitwise_count(body[0] & body[2] & body[4]) + np.bitwise_count(body[1] & body[3] & body[5])
            # codes three apart count six
            distance = head[near] + (n[0] + n[1] + n[2]) + (n[3] + n[4] + n[5]) + three.astype(np.int16) * 3
            hit = np.flatnonzero(distance <= max_distance)
            rows.append(order[near[hit] + begin[x]])
            distances.append(distance[hit])
        if sum(map(len, rows)):
            yield i, np.concatenate(rows), np.concatenate(distances)


def tlsh_neighbours(digests: DataFrame, wanted: DataFrame, max_distance: int = 70,
                    column: str = "tlsh") -> DataFrame:
    """Stored hashes within a distance of the wanted ones (a case's hashes against the store).

    A length step of n > 1 costs 12 n, so only hashes whose length byte lies within max_distance // 12 can
    match; blocks of hashes are held against each other, and there only such hashes are compared. The header
    distance is taken first, and only pairs it leaves room for have their bodies compared.
    """
    def split(df):
        h = df.select(F.col(column).alias("h")).filter(F.col("h").rlike("(?i)^(t1)?[0-9a-f]{70}$")
                                                       ).distinct()
        # bytes are written with their two digits swapped
        return h.withColumn("raw", F.unhex(F.substring(F.regexp_replace(F.lower("h"), "^t1", ""), 1, 70)))
    pairs = _every_pair(split(wanted), split(digests), lambda left, right: _batches(
        _near_locality(left, right, max_distance), left, right, ["h"]), "h_a string, h_b string, distance int")
    return pairs.filter(F.col("h_a") != F.col("h_b")).select(
        F.col("h_b").alias("hash_a"), F.col("h_a").alias("hash_b"), "distance")
