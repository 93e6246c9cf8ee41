"""Cheapest edit scripts between two schema trees: a constrained tree edit distance.

A tree is {name: (types, subtree)}. Nodes of one path are the same node, as names are what tells fields
apart; of the others a node may be renamed, within its parent, where `allowed` says so. A renamed node is
compared with its new self, members and all. Which renames are made is a minimum-cost assignment of gone
to new nodes, whose costs are the distances of the subtrees. What is deleted in one place and inserted
unchanged, under its name, in another is a move.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: What each edit costs; a rename or move costs less than a deletion and an insertion.
DELETE, INSERT, RENAME, RETYPE, MOVE = 1.0, 1.0, 1.0, 0.5, 1.0

Path = tuple[str, ...]
Tree = dict[str, tuple[int, "Tree"]]
#: (parent, old, new) to the number of values that speak for the rename.
Allowed = Mapping[tuple[Path, str, str], int]


@dataclass(frozen=True)
class Edit:
    """kind: removed (old), added (new), renamed, retyped or moved (old, new)."""

    kind: str
    old: Path
    new: Path


def size(tree: Tree) -> int:
    return sum(1 + size(inner) for _, inner in tree.values())


def assignment(cost: list[list[float]]) -> list[int]:
    """For each row of a square matrix the column that it gets in an assignment of least total cost."""
    n = len(cost)
    above, left, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            done[column] = True
            at, best, following = owner[column], float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    slack = cost[at - 1][j - 1] - above[at] - left[j]
                    if slack < least[j]:
                        least[j], came[j] = slack, column
                    if least[j] < best:
                        best, following = least[j], j
            for j in range(n + 1):
                if done[j]:
                    above[owner[j]] += best
                    left[j] -= best
                else:
                    least[j] -= best
            column = following
            if not owner[column]:
                break
        while column:
            owner[column], column = owner[came[column]], came[column]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def renames(gains: Mapping[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The pairs, one per name on either side, with the greatest total gain."""
    olds, news = sorted({o for o, _ in gains}), sorted({n for _, n in gains})
    width = max(len(olds), len(news))
    cost = [[-max(0.0, gains.get((o, n), 0.0)) for n in news] + [0.0] * (width - len(news)) for o in olds] + [[0.0] * width for _ in range(width - len(olds))]
    found = assignment(cost) if width else []
    return [(olds[i], news[j]) for i, j in enumerate(found[: len(olds)]) if j < len(news) and gains.get((olds[i], news[j]), 0.0) > 0]


def _within(before: Tree, after: Tree, old: Path, new: Path, allowed: Allowed) -> tuple[float, list[Edit]]:
    cost, edits = 0.0, []
    for name in sorted(before.keys() & after.keys()):
        (was, inner), (now, outer) = before[name], after[name]
        more, script = _within(inner, outer, (*old, name), (*new, name), allowed)
        retyped = bool(was and now and was != now)
        cost += more + RETYPE * retyped
        # What becomes of the members of an edited node is a part of that edit.
        edits += [Edit("retyped", (*old, name), (*new, name))] if retyped else script
    gone, fresh = before.keys() - after.keys(), after.keys() - before.keys()
    gains = {}
    for o in gone:
        for n in fresh:
            if proof := allowed.get((old, o, n)):
                distance = RENAME + RETYPE * (before[o][0] != after[n][0] and bool(before[o][0] and after[n][0])) + _within(before[o][1], after[n][1], (*old, o), (*new, n), allowed)[0]
                # Equal distances: the pair that more values speak for.
                gains[o, n] = DELETE * (1 + size(before[o][1])) + INSERT * (1 + size(after[n][1])) - distance - 1e-6 / (1 + proof)
    pairs = renames(gains)
    for o, n in pairs:
        cost += DELETE * (1 + size(before[o][1])) + INSERT * (1 + size(after[n][1])) - gains[o, n]
        edits.append(Edit("renamed", (*old, o), (*new, n)))
    for o in sorted(gone - {o for o, _ in pairs}):
        cost += DELETE * (1 + size(before[o][1]))
        edits.append(Edit("removed", (*old, o), ()))
    for n in sorted(fresh - {n for _, n in pairs}):
        cost += INSERT * (1 + size(after[n][1]))
        edits.append(Edit("added", (), (*new, n)))
    return cost, edits


def _nodes(tree: Tree, path: Path):
    """(path, node) of a tree, holders before what they hold."""
    for name, node in sorted(tree.items()):
        yield (*path, name), node
        yield from _nodes(node[1], (*path, name))


def _at(tree: Tree, path: Path) -> tuple[int, Tree]:
    node = (0, tree)
    for name in path:
        node = node[1][name]
    return node


def distance(before: Tree, after: Tree, allowed: Allowed | None = None, *, moves: bool = True) -> tuple[float, list[Edit]]:
    """(cost, script) of the cheapest script from `before` to `after`."""
    cost, edits = _within(before, after, (), (), allowed or {})
    if moves:
        there: dict[tuple, list[Path]] = {}
        for e in edits:
            if e.kind == "added":
                node = _at(after, e.new)
                for path, inner in [(e.new, node), *_nodes(node[1], e.new)]:
                    there.setdefault((path[-1], repr(inner)), []).append(path)
        made: list[Edit] = []
        for e in [e for e in edits if e.kind == "removed"]:
            node = _at(before, e.old)
            for path, inner in [(e.old, node), *_nodes(node[1], e.old)]:
                apart = lambda a, b: a[: len(b)] != b and b[: len(a)] != a
                free = [p for p in there.get((path[-1], repr(inner)), []) if all(apart(p, m.new) for m in made)]
                if free and all(apart(path, m.old) for m in made):
                    made.append(Edit("moved", path, free[0]))
                    cost += MOVE - (DELETE + INSERT) * (1 + size(inner[1]))
        olds, news = {m.old for m in made}, {m.new for m in made}
        edits = [e for e in edits if not (e.kind == "removed" and e.old in olds) and not (e.kind == "added" and e.new in news)] + made
    return cost, sorted(edits, key=lambda e: (e.kind, e.old, e.new))
