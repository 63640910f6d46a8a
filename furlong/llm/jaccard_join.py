"""N-gram Jaccard join: prefix buckets, signature trees inside them, candidate clusters joined exactly by trees."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import forget, id_and_text, partitions, released, written
from .shingles import chunks, mix, shingle_sets

SHINGLE_WORDS, PERCENT = 5, 75
#: A set's bitmap: least bits, and bits for each token (in all a power of two).
BITS, TOKEN_BITS = 512, 4
#: A shingle in more than this share of the documents is heavy; there are at most (mean set size / share) of them.
HEAVY_SHARE = 0.001
#: Sets of a bucket or cluster that one task joins with each other, and their tokens; more are dealt over pairs of blocks.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 4_000_000
LEAF, FAN = 16, 8
#: Bits of a block's own bitmaps; exact while the block shares no more tokens, folded beyond.
BLOCK_BITS = 1 << 14


def required(na, nb, percent: int = PERCENT):
    """The least intersection of linked sets of these sizes, times (100 + percent)."""
    return percent * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Sets in a given order; nodes hold OR-combined bitmaps, size and label ranges and the largest slack.

    A set of n tokens of which `kept` are in its bitmap of b bits shares at most
    popcount(own & other) + kept - b tokens with another set, since each bit outside the
    other's bitmap stands for a token of its own. With ORs and largest slacks the same holds
    for all sets below two nodes. Without collisions the bound of two sets is exact.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray | None = None, kept: np.ndarray | None = None, levels: int = 99):
        label = np.arange(len(n)) if label is None else label
        kept = n if kept is None else kept
        self.levels = [(bits, n, n, kept, kept - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), label, label)]
        while len(self.levels[-1][1]) > LEAF and len(self.levels) < levels:
            cut = np.arange(0, len(self.levels[-1][1]), LEAF if len(self.levels) == 1 else FAN)
            folds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, cut) for f, x in zip(folds, self.levels[-1])))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets of two labels below nodes i and j could link, by size ranges and by the most tokens they can share."""
        or_, low, high, kept, slack, first, last = self.levels[level]
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        ok &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
        i, j, out = i[ok], j[ok], ok
        most = np.bitwise_count(or_[i] & or_[j]).sum(axis=1, dtype=np.int64) + np.minimum(slack[i], slack[j])
        most = np.minimum(most, np.minimum(kept[i], kept[j]))
        out[ok] = (100 + percent) * most >= required(low[i], low[j], percent)
        return out

    def pairs(self, label: np.ndarray, percent: int = PERCENT, step: int = 8_000):
        """Dual traversal from the roots: index arrays (i < j) of sets that could link; pairs of one label, as it is by then, are skipped."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][1]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > step:
                stack += [(level, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
                continue
            if level == 0:
                ok = (i < j) & (label[i] != label[j])
                i, j = i[ok], j[ok]
            ok = self.possible(level, i, j, percent)
            i, j = i[ok], j[ok]
            if level == 0:
                if len(i):
                    yield i, j
                continue
            fan, below = LEAF if level == 1 else FAN, len(self.levels[level - 1][1])
            a, b = np.divmod(np.arange(fan * fan), fan)
            ci, cj = (i[:, None] * fan + a).ravel(), (j[:, None] * fan + b).ravel()
            ok = (ci < below) & (cj < below) & (ci <= cj)
            if ok.any():
                stack.append((level - 1, ci[ok], cj[ok]))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the sets i and j of each pair, and all that have their labels, one label; in place."""
    while (apart := label[i] != label[j]).any():
        i, j = i[apart], j[apart]
        parent = np.arange(int(label.max()) + 1)
        np.minimum.at(parent, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (parent != (above := parent[parent])).any():
            parent = above
        label[:] = parent[label]


def _moved(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One set of each label that was united with another, and one that has the label it now has: a pair for each, no more."""
    _, first = np.unique(before, return_index=True)
    moved = first[after[first] != before[first]]
    return moved, first[np.searchsorted(before[first], after[moved])]


def _sets(batch, k: int):
    """(position, id, sorted shingle hashes) of a batch's documents."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for a, b in chunks(texts):
        for i, s in enumerate(shingle_sets(texts[a:b], k), a):
            yield ids[i], s


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, without regard to order, as two longs."""
    return tuple(int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(c)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) for c in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))


def bitmap(s: np.ndarray) -> bytes:
    size = max(BITS, 1 << (TOKEN_BITS * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[s & np.uint64(size - 1)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap at a smaller size: its parts one over the other, which keeps every bound valid."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 64), axis=0)


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            rows = [(i, len(s), *(set_id(s) if len(s) else (None, None)), bitmap(s) if len(s) else None) for i, s in _sets(batch, k)]
            c = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())], names=["doc_id", "n", "sid", "check", "bits"])

    return released(run)


def _tokens(k: int):
    """Documents' sets themselves, with their ids."""

    def run(batches):
        for batch in batches:
            rows = [(i, *set_id(s), s.tobytes()) for i, s in _sets(batch, k) if len(s)]
            for at in range(0, len(rows), 500):
                c = list(zip(*rows[at : at + 500]))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.binary())], names=["doc_id", "sid", "check", "tokens"])

    return released(run)


def _often(k: int, share: float, at_once: int = 2_000_000):
    """Shingles that are frequent among the documents of a part, with their counts there."""

    def run(batches):
        held, size, docs = [], 0, 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(4, share * docs / 2)
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "c"])

        for batch in batches:
            for _, s in _sets(batch, k):
                held.append(s)
                size, docs = size + len(s), docs + 1
                if size >= at_once:
                    yield flush()
                    held, size, docs = [], 0, 0
        if held:
            yield flush()

    return released(run)


def _entries(k: int, percent: int, heavy):
    """Each set's prefix, rarest shingles first: (bucket, m, sid); heavy shingles have a bucket for each pair of blocks.

    m is twice the set's size, and one more where only a smaller set may meet it: of two linked
    sets, the smaller shares one of its first n - ceil(2 t / (1 + t) n) + 1 shingles.
    """

    def run(batches):
        tokens, counts = heavy.value
        seen = set()
        for batch in batches:
            buckets, sids, sizes = [], [], []
            for _, s in _sets(batch, k):
                if not len(s) or (sid := set_id(s)[0]) in seen:
                    continue
                if len(seen) >= 100_000:  # copies further apart are found after the shuffle
                    seen.clear()
                seen.add(sid)
                need = len(s) - -(-percent * len(s) // 100) + 1
                at = np.searchsorted(tokens, s)
                hot = np.zeros(len(s), np.int64)
                if len(tokens):
                    at = np.minimum(at, len(tokens) - 1)
                    hot = np.where(tokens[at] == s, counts[at], 0)
                # sets are sorted by hash, so that a stable sort by count orders ties alike everywhere
                chosen = np.argsort(hot, kind="stable")[:need] if hot.any() else np.arange(need)
                own, many = s[chosen], -(-hot[chosen] // BLOCK_DOCS)
                late = np.arange(need) > len(s) - -(-2 * percent * len(s) // (100 + percent))
                late = np.append(late[many <= 1], np.repeat(late[many > 1], many[many > 1]))
                for t, g in zip(own[many > 1], many[many > 1].tolist()):
                    block = sid % g
                    others = np.arange(g)
                    pair = np.minimum(block, others) * g + np.maximum(block, others) + 1
                    own = np.append(own, mix(t ^ mix(pair.astype(np.uint64))))
                own = np.concatenate([own[: len(chosen)][many <= 1], own[len(chosen) :]])
                buckets.append(own)
                sids.append(np.full(len(own), sid, np.int64))
                sizes.append((2 * len(s) + late).astype(np.int32))
            if buckets:
                b, s, n = np.concatenate(buckets).view(np.int64), np.concatenate(sids), np.concatenate(sizes)
                for at in range(0, len(b), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in (b, n, s)], names=["bucket", "m", "sid"])

    return released(run)


def _whole_runs(batches):
    """Batches sorted by their first column, cut so that no run of equal values is split."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(first, first[-1]))
        if cut == 0 and held and held[-1].column(0)[-1].as_py() == first[0]:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _shared(percent: int):
    """Sorted (bucket, m, sid) -> rows of buckets with two sets or more of sizes that can link.

    Sizes in order are cut where neighbours differ too much to link, so a bucket becomes one
    or several; rows before the first that may be the smaller set of a link have no partner.
    `leader` is the first set of the bucket, or the one before where the first is too small to
    link.
    """
    apart = lambda b, n: np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (100 * n[:-1] < percent * n[1:])))

    def run(batches):
        for t in _whole_runs(batches):
            b, m, s = (t.column(i).to_numpy() for i in range(3))
            if not len(b):
                continue
            new = np.append(True, (b[1:] != b[:-1]) | (s[1:] != s[:-1]))
            b, m, s = b[new], m[new].astype(np.int64), s[new]
            starts = apart(b, m >> 1)
            first = np.minimum.reduceat(np.where(m & 1, len(m), np.arange(len(m))), starts)
            keep = np.arange(len(m)) >= np.repeat(first, np.diff(np.append(starts, len(m))))
            b, n, s = b[keep], m[keep] >> 1, s[keep]
            if not len(b):
                continue
            starts = apart(b, n)
            sizes = np.diff(np.append(starts, len(b)))
            many = np.repeat(sizes > 1, sizes)
            first, before = np.repeat(starts, sizes), np.maximum(np.arange(len(b)) - 1, 0)
            leader = s[np.where(100 * n[first] >= percent * n, first, before)]
            own = mix(b.view(np.uint64) ^ mix(n[first].astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[many]), pa.array(s[many]), pa.array(leader[many])], names=["bucket", "sid", "leader"])

    return released(run)


def _mixed(batches):
    """Sorted (bucket, sid, component) -> rows of buckets with two components or more.

    A bucket is renamed by its sets: shingles of one passage often have the same documents,
    and those buckets then are one. A bucket of more than BLOCK_DOCS sets becomes one for each
    pair of its blocks.
    """
    for t in _whole_runs(batches):
        b, s, c = (t.column(i).to_numpy() for i in range(3))
        if not len(b):
            continue
        starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        sizes = np.diff(np.append(starts, len(b)))
        run = np.repeat(np.arange(len(starts)), sizes)
        keep = (np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts))[run]
        name = mix(np.add.reduceat(mix(s.view(np.uint64)), starts))[run]
        small = keep & (sizes <= BLOCK_DOCS)[run]
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)[small]), pa.array(s[small]), pa.array(c[small])], names=["bucket", "sid", "component"])
        for k in np.flatnonzero(sizes > BLOCK_DOCS):
            own = np.arange(starts[k], starts[k] + sizes[k])
            if keep[own[0]]:
                blocks = np.array_split(own, -(-len(own) // BLOCK_DOCS))
                for x, one in enumerate(blocks):
                    for y, other in enumerate(blocks[: x + 1]):
                        both = np.append(one, other) if x != y else one
                        pair = np.full(len(both), mix(name[own[0]] ^ mix(np.array([x * len(blocks) + y + 1], np.uint64)))[0])
                        yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(s[both]), pa.array(c[both])], names=["bucket", "sid", "component"])


def _each_pair(t: pa.Table, label: np.ndarray, percent: int, take) -> None:
    """take(i, j) for rows (bucket, n, sid, component, bits) of one bucket that could link; labels that it changes count from then on.

    Sets that can link have bitmaps of one size or of neighbouring ones, so each size is
    compared with itself and, folded, with the next, and a small set costs long ones nothing.
    """
    b, n = t.column(0).to_numpy(), t.column(1).to_numpy()
    whole = t.column(4).to_pylist()
    width = np.array([8 * len(x) for x in whole])
    for k in np.unique(width):
        own = np.flatnonzero((width == k) | (width == 2 * k))
        own = own[np.isin(b[own], b[width == k])]
        bits, bucket, here = np.stack([folded(whole[i], k) for i in own]), b[own], width[own] == k
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(cut, len(own)))
        small = np.flatnonzero(np.repeat(size <= LEAF, size))
        leaf = SignatureTree(n[own], bits, levels=1)
        for d in range(1, LEAF):
            i = small[small + d < len(own)]
            i = i[(bucket[i] == bucket[i + d]) & (here[i] | here[i + d]) & (label[own[i]] != label[own[i + d]])]
            i = i[leaf.possible(0, i, i + d, percent)]
            take(own[i], own[i + d])
        for s, e in zip(cut[size > LEAF], (cut + size)[size > LEAF]):
            now = label[own[s:e]]
            for i, j in SignatureTree(n[own[s:e]], bits[s:e], now.copy()).pairs(now, percent):
                ok = here[s + i] | here[s + j]
                take(own[s + i[ok]], own[s + j[ok]])
                now[:] = label[own[s:e]]


def _candidates(percent: int):
    """Sorted (bucket, n, sid, component, bits) -> (a, b): components that the buckets' trees can't keep apart, one pair for each that was united."""

    def run(batches):
        for t in _whole_runs(batches):
            comp = t.column(3).to_numpy()
            if not len(comp):
                continue
            _, label = np.unique(comp, return_inverse=True)
            before = label.copy()
            _each_pair(t, label, percent, lambda i, j: unite(label, i, j))
            moved, root = _moved(before, label)
            yield pa.RecordBatch.from_arrays([pa.array(comp[root]), pa.array(comp[moved])], names=["a", "b"])

    return released(run)


def _possible(percent: int):
    """(a, na, bits_a, b, nb, bits_b) -> pairs whose whole bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            na, nb, ba, bb = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            size = np.array([8 * min(len(x), len(y)) for x, y in zip(ba, bb)])
            ok = np.zeros(len(size), bool)
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                bits = np.stack([folded(x[i], k) for x in (ba, bb) for i in own])
                at = np.arange(len(own))
                ok[own] = SignatureTree(np.array([x[i] for x in (na, nb) for i in own]), bits, np.arange(2 * len(own)), levels=1).possible(0, at, at + len(own), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return released(run)


def join_sets(sets: list[np.ndarray], label: np.ndarray, block: np.ndarray, percent: int = PERCENT) -> None:
    """Unite the labels of all sets that link; of two blocks, only sets of different ones are compared.

    Tokens that only one set has can't be shared, and a set left with too few shared ones for
    any link drops out, until that changes nothing. The tokens left get numbers of the block's
    own, so that a bitmap of BLOCK_BITS or fewer is exact and the tree's bound decides; folded
    bitmaps only bound, and the sets themselves decide.
    """
    n, cross = np.array([len(s) for s in sets]), bool((block != block[0]).any())
    if len(sets) <= 4:
        for i in range(len(sets)):
            for j in range(i):
                if label[i] != label[j] and (block[i] != block[j] or not cross) and linked(sets[i], sets[j], percent):
                    unite(label, np.array([i]), np.array([j]))
        return
    owner = np.repeat(np.arange(len(sets)), n)
    tokens, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    while True:
        kept = np.bincount(owner[count[token] > 1], minlength=len(sets))
        live = 100 * kept >= percent * n
        stay = live[owner] & (count[token] > 1)
        if stay.all():
            break
        owner, token = owner[stay], token[stay]
        count = np.bincount(token, minlength=len(tokens))
    if not len(owner):
        return
    rows = np.flatnonzero(live)
    kept, first = kept[rows], token[np.searchsorted(owner, rows)]
    order = np.lexsort((n[rows], first))  # by the smallest shared token: like sets stand together
    rows, kept = rows[order], kept[order]
    place = np.zeros(len(sets), np.int64)
    place[rows] = np.arange(len(rows))
    numbers, number = np.unique(token, return_inverse=True)
    exact = len(numbers) <= BLOCK_BITS
    size = -(-min(len(numbers), BLOCK_BITS) // 64) * 64
    bits = np.zeros(len(rows) * size // 8, np.uint8)
    at = place[owner] * size + number % size
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    now = label[rows]
    for i, j in SignatureTree(n[rows], bits.view(np.uint64).reshape(len(rows), -1), now.copy(), kept).pairs(now, percent):
        i, j = rows[i], rows[j]
        if cross:
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        for k in range(0, len(i), len(i) if exact else 64):
            a, b = i[k : k + (len(i) if exact else 64)], j[k : k + (len(i) if exact else 64)]
            if not exact:
                apart = label[a] != label[b]
                ok = np.array([linked(sets[x], sets[y], percent) for x, y in zip(a[apart], b[apart])], bool)
                a, b = a[apart][ok], b[apart][ok]
            unite(label, a, b)
        now[:] = label[rows]


def _joined(percent: int):
    """Sorted (key, block, doc_id, component, tokens) -> (src, dst): documents of components that links unite, one pair for each."""

    def run(batches):
        for t in _whole_runs(batches):
            key, block, doc, component = (t.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            tokens, src, dst = t.column(4), [], []
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for s, e in zip(starts, np.append(starts[1:], len(key))):
                _, label = np.unique(component[s:e], return_inverse=True)
                before = label.copy()
                if label.any():
                    join_sets([np.frombuffer(tokens[i].as_buffer(), np.uint64) for i in range(s, e)], label, block[s:e], percent)
                    moved, root = _moved(before, label)
                    src.append(doc[s:e][root])
                    dst.append(doc[s:e][moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (src, dst)], names=["src", "dst"])

    return released(run)


def jaccard_join(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have Jaccard similarity of percent / 100 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach). No link between different sets is lost:

    1. Equal sets (128 bits) collapse to their smallest document, so copies cost nothing
       further on.
    2. Linked sets share a shingle of their prefixes (the rarest n - ceil(t n) + 1, and fewer for
       the smaller of the two). Frequent
       shingles, counted over all documents, come last in the order; that changes which
       buckets arise, never whether a pair meets. Buckets of one set fall away.
    3. Candidate clusters: in each bucket a star, then signature trees (OR-combined bitmaps and
       size ranges, traversed against themselves) unite whatever the bitmaps can't keep apart.
       Bitmaps are compared with those of their own size or the next, as sizes of linked sets
       are.
       A bucket yields one pair for each cluster that it unites, however many could link, and
       buckets within one cluster yield none. Two sets that link are in one cluster.
    4. Each cluster is joined exactly, every set of it once, by a signature tree over the
       cluster's own token numbers; again one pair comes out for each component that was united.
       Clusters beyond BLOCK_DOCS sets or BLOCK_TOKENS tokens are dealt over blocks: first each
       block alone, then each two blocks.

    Heavy shingles (more than HEAVY_SHARE of all documents, so a list of bounded length) are
    dealt over pairs of blocks of BLOCK_DOCS sets, and so are larger buckets of others.

    Defined cases: null or empty text has no shingles, links with nothing and is its own
    component; fewer than k words are one shingle; repeated rows are copies; of equal ids the
    text of the smallest id stands for the set; a null id has a null component. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    rows = written(texts.mapInArrow(_signatures(k), "doc_id long, n long, sid long, check long, bits binary"), "signatures")
    ids = written(rows.select("doc_id", "n", "sid", "check"), "ids")
    sets = ids.where("sid is not null and doc_id is not null").groupBy("sid", "check").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    floor = max(64, int(HEAVY_SHARE * ids.count()))
    often = texts.mapInArrow(_often(k, HEAVY_SHARE), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= floor).toArrow()
    tokens, counts = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(tokens)
    heavy = spark.sparkContext.broadcast((tokens[order], counts[order]))
    entries = texts.where("doc_id is not null").mapInArrow(_entries(k, percent, heavy), "bucket long, m int, sid long")
    by = lambda df, key, *order: df.repartition(partitions(spark), key).sortWithinPartitions(key, *order)
    shared = written(by(entries, "bucket", "m", "sid").mapInArrow(_shared(percent), "bucket long, sid long, leader long"), "buckets")
    signatures = written(rows.select("sid", "check", "n", "bits").join(shared.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid", "check"]), "shared-signatures")
    forget(rows)

    side = lambda x: signatures.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    stars = shared.where("sid != leader").select(F.least("leader", "sid").alias("a"), F.greatest("leader", "sid").alias("b")).distinct()
    near = stars.join(side("a"), "a").join(side("b"), "b").select("a", "na", "bits_a", "b", "nb", "bits_b").mapInArrow(_possible(percent), "a long, b long")
    starred = connected_components(near, src="a", dst="b")
    known = signatures.select("sid").distinct().join(starred.withColumnRenamed("id", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"))
    mixed = by(shared.select("bucket", "sid").join(known, "sid").select("bucket", "sid", "component"), "bucket").mapInArrow(_mixed, "bucket long, sid long, component long").dropDuplicates(["bucket", "sid"])
    nodes = by(mixed.join(signatures.select("sid", "n", "bits"), "sid").select("bucket", "n", "sid", "component", "bits"), "bucket", "n", "sid")
    further = connected_components(nodes.mapInArrow(_candidates(percent), "a long, b long"), src="a", dst="b")
    clusters = known.join(further.select(F.col("id").alias("component"), F.col("component").alias("cluster")), "component", "left").select("sid", F.coalesce("cluster", "component").alias("cluster"))

    member = clusters.join(sets, "sid")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_TOKENS)).cast("int")
    dealt = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), blocks.alias("blocks")).where("size > 1")
    member = written(member.join(dealt, "cluster").select("sid", "check", "doc_id", "cluster", "blocks"), "members")
    forget(shared, signatures)
    found = texts.join(member.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_tokens(k), "doc_id long, sid long, check long, tokens binary")
    block = F.pmod(F.xxhash64("sid", "check"), "blocks")
    clustered = written(found.join(member, ["sid", "check", "doc_id"]).dropDuplicates(["sid", "check"]).select("cluster", "blocks", block.alias("block"), "doc_id", "tokens"), "clusters")
    joined = lambda df: by(df, "key").select("key", "block", "doc_id", "component", "tokens").mapInArrow(_joined(percent), "src long, dst long")
    links = written(joined(clustered.select(F.xxhash64("cluster", "block").alias("key"), "block", "doc_id", F.col("doc_id").alias("component"), "tokens")), "links")
    components = connected_components(links)
    large = clustered.where("blocks > 1")
    if not large.isEmpty():
        large = large.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
        pairs = large.select("*", other.alias("other")).withColumn("key", F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")))
        components = connected_components(links.union(written(joined(pairs), "links")))
    of_set = sets.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("sid", "check", F.coalesce("component", "doc_id").alias("component"))
    return ids.select("doc_id", F.col("n").alias("n_shingles"), "sid", "check").join(of_set, ["sid", "check"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def brute(rows: list[tuple], k: int = SHINGLE_WORDS, percent: int = PERCENT) -> dict:
    """doc_id -> (n_shingles, component_id) by comparing all pairs, for tests."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    ra, rb = root(a), root(b)
                    comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}
