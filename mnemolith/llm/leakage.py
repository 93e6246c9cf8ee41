"""Evaluation texts leaking into training text (problem 9).

The items are taken in blocks of bounded size, of which the driver holds one at a time; the corpus is read
once per block and never shuffled. Shared four-word seeds of an item's own wording name the (item, document)
pairs to look at. Each pair goes through greedy string tiling: the longest common runs of unmarked words,
found by running Karp-Rabin hashes, are marked as tiles, longest first; a run is found once, however
often its words repeat. Tiles that follow one another in
both texts are chained into passages; the words between them count as edits. As a tile uses up the words
of the item for the whole window, an exact banded edit distance around the seeds' diagonals then looks for
the longest passage at each place of the document. Coverage, the share of the item's own words that lie in
tiles, doesn't depend on their order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import words

SEED = 4
_OUT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("passage_words", pa.int32()), ("edits", pa.int32()), ("coverage", pa.float64())])
_DDL = "item_id bigint, doc_id bigint, passage_words int, edits int, coverage double"


@dataclass
class Items:
    """A block of items as word numbers, with the seeds of their own wording."""

    vocabulary: dict[str, int]
    texts: dict[int, list[int]]
    own: dict[int, list[bool]]
    keys: np.ndarray
    where: list[list[tuple[int, list[int]]]]


def _grams(text: list[str]) -> set[tuple[str, ...]]:
    return {tuple(text[i : i + SEED]) for i in range(len(text) - SEED + 1)}


def _grams_of(batches):
    for batch in batches:
        grams = ["\0".join(g) for text in batch["text"].to_pylist() for g in _grams(words(text))]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string())], names=["gram"])


def common_wording(texts: DataFrame, share: float) -> set[tuple[str, ...]]:
    """Seeds that occur in more than `share` of all item texts, and in more than three.

    Counted on the cluster; as a text has no more seeds than words, what comes back is bounded by the
    length of a text over the share.
    """
    least = max(3.0, share * texts.count())
    counted = texts.select("text").mapInArrow(_grams_of, "gram string").groupBy("gram").agg(F.count("*").alias("n"))
    return {tuple(r[0].split("\0")) for r in counted.where(F.col("n") > least).collect()}


def prepare_items(block: list[tuple[int, list[str]]], common: set[tuple[str, ...]]) -> Items:
    vocabulary: dict[str, int] = {}
    texts, own = {}, {}
    seeds: dict[int, dict[int, list[int]]] = defaultdict(dict)
    for item, text in block:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in text]
        mine = [True] * len(ids)
        for i in range(len(text) - SEED + 1):
            if tuple(text[i : i + SEED]) in common:
                mine[i : i + SEED] = [False] * SEED
        texts[item], own[item] = ids, mine
        for i in range(len(ids) - SEED + 1):
            if all(mine[i : i + SEED]):
                seeds[_key(ids[i : i + SEED])].setdefault(item, []).append(i)
    keys = np.array(sorted(seeds), np.uint64)
    return Items(vocabulary, texts, own, keys, [list(seeds[int(k)].items()) for k in keys])


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _key(ids: list[int]) -> int:
    key = 0
    for i in ids:
        key = (key * int(_MIX) + i) & 0xFFFFFFFFFFFFFFFF
    return key


def _rolling(text: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` words."""
    ids = text.astype(np.uint64)
    n = max(0, len(ids) - size + 1)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * _MIX + ids[k : k + n]
    return key


def _runs_by_hash(a: np.ndarray, b: np.ndarray, size: int, order: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    j = np.repeat(np.arange(len(many)), many)
    i = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(j))]
    same = np.ones(len(j), bool)
    for k in range(size):
        same &= a[i + k] == b[j + k]
    i, j = i[same], j[same]
    place = np.lexsort([j, j - i])
    i, j = i[place], j[place]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(j) != 1)))) if len(j) else np.empty(0, np.int64)
    return i[first], j[first], np.diff(np.append(first, len(j))) + size - 1


def _runs_by_diagonal(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(len(a), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([none, b, none]), len(a))
    step = max(1, (1 << 24) // len(a))
    parts = []
    for lo in range(0, len(windows), step):
        same = np.zeros((len(windows[lo : lo + step]), len(a) + 1), np.int8)
        same[:, :-1] = windows[lo : lo + step] == a
        change = np.diff(same.ravel(), prepend=0)
        begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = ends - begins >= size
        begins, n = begins[long], (ends - begins)[long]
        i = begins % (len(a) + 1)
        parts.append((i, lo + begins // (len(a) + 1) - len(a) + i, n))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def runs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """All common runs of `size` words or more that can't be longer: (start in a, start in b, length).

    Hashes are joined where few places are equal. Where words repeat so much that most are, diagonals are
    compared directly, which takes no longer the more is equal.
    """
    if len(a) < size or len(b) < size:
        return (np.empty(0, np.int64),) * 3
    key = _rolling(a, size)
    order = np.argsort(key, kind="stable")
    wanted = _rolling(b, size)
    low = np.searchsorted(key[order], wanted, "left")
    many = np.searchsorted(key[order], wanted, "right") - low
    if 16 * int(many.sum()) > len(a) * (len(a) + len(b)):
        return _runs_by_diagonal(a, b, size)
    return _runs_by_hash(a, b, size, order, low, many)


def tiles(a: list[int], b: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping common runs (start in a, start in b, length), longest first.

    Number 0 in b is a word that a lacks. Equally long ones are taken from the left. Of a run that a longer
    tile has cut into, the parts that are left are runs of their own.
    """
    left, right = np.asarray(a, np.int64), np.asarray(b, np.int64)
    queue = [(-n, i, j) for i, j, n in zip(*(c.tolist() for c in runs(left, right, shortest)), strict=True)]
    heapq.heapify(queue)
    free_a, free_b = np.ones(len(left), bool), np.ones(len(right), bool)
    found: list[tuple[int, int, int]] = []
    unused = len(left)
    while queue and unused >= shortest:
        n, i, j = heapq.heappop(queue)
        free = free_a[i : i - n] & free_b[j : j - n]
        if free.all():
            free_a[i : i - n] = free_b[j : j - n] = False
            found.append((i, j, -n))
            unused += n
        elif free.any():
            change = np.diff(np.concatenate(([0], free.view(np.int8), [0])))
            for lo, hi in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
                if hi - lo >= shortest:
                    heapq.heappush(queue, (lo - hi, i + lo, j + lo))
    return found


def _distance(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def passage(a: list[int], b: list[int], found: list[tuple[int, int, int]], own: list[bool], least: int, gap: int = 4, per_edit: int = 8) -> tuple[int, int]:
    """(words, edits) of the longest passage of own wording that is close enough, else of the longest one.

    A passage is a chain of tiles in the order of both texts with at most `gap` words between two, and, at
    its ends, single words beyond an edit. Close enough is one edit for every `per_edit` words begun. Edits
    that leave no tile between them are beyond it: `closest` has no such limits.
    """
    best = (False, 0, 0)
    at = sorted(found)
    reach: list[list[tuple[int, int, int, int]]] = []
    for k, (i, j, n) in enumerate(at):
        mine = _trim(own, i, n)
        chains = [(mine[0], i + n, j + n, 0)] if mine else []
        for p in range(k):
            pi, pj, pn = at[p]
            gi, gj = i - pi - pn, j - pj - pn
            if 0 <= gi <= gap and 0 <= gj <= gap and all(own[pi + pn - 1 : i + 1]):
                cost = _distance(a[pi + pn : i], b[pj + pn : j])
                chains += [(s, i + n, j + n, e + cost) for s, _, _, e in reach[p]]
        # Per start the fewest edits suffice.
        fewest: dict[int, tuple[int, int, int, int]] = {}
        for c in chains:
            if c[0] not in fewest or c[3] < fewest[c[0]][3]:
                fewest[c[0]] = c
        reach.append(list(fewest.values()))
    first = {}
    for i, j, _ in at:
        first[i] = j
    for chains in reach:
        for start, end, end_b, edits in chains:
            for s, e, more in _ends(a, b, own, start, first.get(start), end, end_b):
                while e > s and not own[e - 1]:
                    e -= 1
                n, total = e - s, edits + more
                close = n >= least and total <= -(-n // per_edit)
                best = max(best, (close, n, -total))
    return (best[1], -best[2]) if best[0] else (min(best[1], least - 1), -best[2])


def _trim(own: list[bool], i: int, n: int) -> tuple[int] | None:
    """Where the own wording of a tile begins; None if it has none."""
    while n and not own[i]:
        i, n = i + 1, n - 1
    return (i,) if n else None


def _ends(a: list[int], b: list[int], own: list[bool], start: int, start_b: int | None, end: int, end_b: int) -> list[tuple[int, int, int]]:
    """A passage as it is, and with up to two words taken in beyond one edit at either end."""
    left, right = [(start, 0)], [(end, 0)]
    for da, db in ((1, 1), (1, 0), (0, 1)):
        n = 0
        while n < 2 and end + da + n < len(a) and end_b + db + n < len(b) and a[end + da + n] == b[end_b + db + n]:
            n += 1
        if n:
            right.append((end + da + n, 1))
        if start_b is not None:
            n = 0
            while n < 2 and start - da - n - 1 >= 0 and start_b - db - n - 1 >= 0 and a[start - da - n - 1] == b[start_b - db - n - 1] and own[start - da - n - 1]:
                n += 1
            if n and all(own[start - da - n : start]):
                left.append((start - da - n, 1))
    return [(s, e, x + y) for s, x in left for e, y in right if all(own[end:e])]


def closest(a: list[int], own: list[bool], text: list[int], diagonals: set[int], least: int, per_edit: int = 8) -> tuple[int, int]:
    """(words, edits) of the longest passage of at least `least` own words that is close enough, else (0, 0).

    Exact for passages that touch one of the `diagonals` (place in text less place in a): the edits of a
    passage bound how far it can leave them. A passage begins and ends with words that both texts have;
    what is edited, and the words beside it, are own. Close enough is one edit for every `per_edit` words begun.
    """
    far = -(-len(a) // per_edit)
    bands: list[list[int]] = []
    for d in sorted(diagonals):
        if bands and d - bands[-1][0] <= far:
            bands[-1][1] = d
        else:
            bands.append([d, d])
    none = 1 << 20
    best = (0, 0)
    whole = len(a) - own.index(True) - own[::-1].index(True) if any(own) else 0
    for first, last in bands:
        if best == (whole, 0):
            break
        base, width = first - far, last - first + 2 * far + 1
        stretch = np.zeros(len(a) + width - 1, np.int64)
        lo, hi = max(base, 0), min(base + len(stretch), len(text))
        stretch[lo - base : hi - base] = text[lo:hi]
        same = np.lib.stride_tricks.sliding_window_view(stretch, width) == np.array(a, np.int64)[:, None]
        steps = np.arange(width)
        # Fewest edits per start in a (rows, ascending) and diagonal, when a is used up to word i.
        cost, starts = np.empty((0, width), np.int64), np.empty(0, np.int64)
        for i, hit in enumerate(same):
            new = np.where(hit, cost, none)
            if own[i]:
                if hit.any():
                    new = np.vstack([new, np.where(hit, 0, none)])
                    starts, cost = np.append(starts, i), np.vstack([cost, np.full(width, none)])
                n = i + 1 - starts
                edits = new.min(axis=1, initial=none)
                ok = np.flatnonzero((n >= least) & (edits <= -(-n // per_edit)))
                if len(ok):
                    best = max(best, (int(n[ok[0]]), int(edits[ok[0]])), key=lambda x: (x[0], -x[1]))
                if 0 < i < len(a) - 1 and own[i - 1] and own[i + 1]:
                    new = np.minimum(new, cost + 1)
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                if i < len(a) - 1 and own[i + 1]:
                    new = np.minimum.accumulate(new - steps, axis=1) + steps
            # A later start with no fewer edits can't lead to a longer passage.
            if len(starts) > 1:
                new[1:][new[1:] >= np.minimum.accumulate(new, axis=0)[:-1]] = none
            alive = new.min(axis=1, initial=none) <= far
            cost, starts = new[alive], starts[alive]
    return best


def _search(items: Items, least: int, shortest: int):
    longest = max(map(len, items.texts.values()), default=0)

    def search(batches):
        get = items.vocabulary.get
        for batch in batches:
            rows: list[tuple] = []
            docs, starts = [], [0]
            flat: list[int] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                # Three zeros keep seeds from reaching over the end of a document.
                flat += [get(w, 0) for w in words(text)]
                flat += (0, 0, 0)
                docs.append(doc)
                starts.append(len(flat))
            ids = np.array(flat, np.uint64)
            hits: dict[tuple[int, int], list[tuple[int, list[int]]]] = defaultdict(list)
            if len(ids) >= SEED and len(items.keys):
                at = np.flatnonzero((ids[:-3] != 0) & (ids[1:-2] != 0) & (ids[2:-1] != 0) & (ids[3:] != 0))
                key = ids[at]
                for k in range(1, SEED):
                    key = key * _MIX + ids[at + k]
                place = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
                ok = items.keys[place] == key
                at, place = at[ok], place[ok]
                of = np.searchsorted(np.array(starts), at, "right") - 1
                for p, k, d in zip(at.tolist(), place.tolist(), of.tolist(), strict=True):
                    for item, where in items.where[k]:
                        hits[(item, d)].append((p, where))
            for (item, d), places in hits.items():
                rows.append((item, docs[d], *_judge(items, item, flat, starts[d], starts[d + 1] - 3, places, longest, least, shortest)))
            columns = list(zip(*rows, strict=True)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)

    return search


def _judge(items: Items, item: int, flat: list[int], start: int, stop: int, places: list[tuple[int, list[int]]], longest: int, least: int, shortest: int) -> tuple[int, int, float]:
    """Longest passage, its edits and the item's coverage, over the stretches of the document near seeds."""
    a, own = items.texts[item], items.own[item]
    known = set(a)
    best, covered = (0, 0), [False] * len(a)
    spans: list[list[int]] = []
    for p in sorted({p for p, _ in places}):
        lo, hi = max(start, p - 2 * longest), min(stop, p + SEED + 2 * longest)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        # A stretch that is long because seeds abound is tiled in overlapping windows.
        step = 8 * max(longest, 1)
        for at in range(lo, hi, step):
            b = [w if w in known else 0 for w in flat[at : min(hi, at + step + 4 * longest)]]
            found = tiles(a, b, shortest)
            best = max(best, passage(a, b, found, own, least), key=lambda x: (x[0] >= least, x[0], -x[1]))
            for i, _, n in found:
                covered[i : i + n] = [True] * n
    # The diagonals of seeds, over the whole document: what one quote uses up another still has.
    best = max(best, closest(a, own, flat[start:stop], _diagonals(places, start, len(a), stop - start), least), key=lambda x: (x[0] >= least, x[0], -x[1]))
    mine = sum(own)
    return best[0], best[1], sum(c and o for c, o in zip(covered, own, strict=True)) / mine if mine else 0.0


def _diagonals(places: list[tuple[int, list[int]]], start: int, height: int, width: int) -> set[int]:
    """Where in the document, less where in the item, seeds are.

    Of a seed that the item repeats all that lies between its first and last place counts, so that work
    doesn't grow with the number of pairs.
    """
    out = {p - start - i for p, where in places if len(where) <= 8 for i in where}
    step = np.zeros(height + width + 2, np.int64)
    for p, where in places:
        if len(where) > 8:
            step[p - start - where[-1] + height] += 1
            step[p - start - where[0] + height + 1] -= 1
    return out | set((np.flatnonzero(np.cumsum(step)) - height).tolist())


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of at most `block_words` words, or of one item."""
    block: list[tuple[int, list[str]]] = []
    held, seen = 0, set()
    for item, text in items.orderBy("item").toLocalIterator():
        mine = words(text)
        # Two texts of one item never share a block, so that each has its own place.
        if block and (held + len(mine) > block_words or item in seen):
            yield block
            block, held, seen = [], 0, set()
        block.append((item, mine))
        held += len(mine)
        seen.add(item)
    if block:
        yield block


def leaks(
    items: DataFrame, documents: DataFrame, *, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
    least: int = 15, shortest: int = 3, common_share: float = 0.1, block_words: int = 2_000_000,
) -> DataFrame:
    """(item_id, doc_id, passage_words, edits, coverage) for documents that share seeds with an item.

    `passage_words` >= `least` means that the document holds so many consecutive words of the item's own
    wording, about one in eight of them edited. Own is what more than `common_share` of the items don't
    share. Null or empty texts hold nothing; items with fewer than `least` own words can't be found. An
    item id that occurs more than once is several texts of one item, a repeated doc_id gives a row per
    copy. Items come in blocks of at most `block_words` words (a block is what is broadcast); every block
    is searched for in all documents.
    """
    texts = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item is not null")
    common = common_wording(texts, common_share)
    corpus = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[doc_text].alias("text"))
    search = lambda block: corpus.mapInArrow(_search(prepare_items(block, common), least, shortest), _DDL)
    blocks = _blocks(texts, block_words)
    block, following = next(blocks, []), next(blocks, None)
    out = search(block)
    # With several blocks each is searched for at once, so that the driver can let go of it.
    if following is not None:
        out = cut(out)
    while following is not None:
        block, following = following, next(blocks, None)
        out = out.unionByName(cut(search(block)))
    return out
