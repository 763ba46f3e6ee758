"""The two-level cache: a splay tree of recent results before exact search, folded over an ordered query log.

What a query finds depends on all queries before it in its session, so a session is a fold, run by
applyInPandas; sessions run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx

_KEY, _VALUE, _LEFT, _RIGHT, _UP = range(5)


class SplayTree:
    """A self-adjusting search tree by text key with a bound on its size; nodes are lists (key, value, left, right, parent)."""

    def __init__(self, capacity: int = 50) -> None:
        self.root: list | None = None
        self.size, self.capacity = 0, capacity

    def _find(self, key: str) -> tuple[list | None, int]:
        at, depth = self.root, 0
        while at is not None and at[_KEY] != key:
            at = at[_LEFT] if key < at[_KEY] else at[_RIGHT]
            depth += 1
        return at, depth

    def _rotate(self, child: list) -> None:
        """child moves over its parent."""
        up = child[_UP]
        side, other = (_LEFT, _RIGHT) if up[_LEFT] is child else (_RIGHT, _LEFT)
        over = up[_UP]
        up[side] = child[other]
        if up[side] is not None:
            up[side][_UP] = up
        child[other], up[_UP], child[_UP] = up, child, over
        if over is None:
            self.root = child
        else:
            over[_LEFT if over[_LEFT] is up else _RIGHT] = child

    def _splay(self, node: list) -> None:
        while node[_UP] is not None:
            up = node[_UP]
            over = up[_UP]
            if over is not None:
                straight = (over[_LEFT] is up) == (up[_LEFT] is node)
                self._rotate(up if straight else node)
            self._rotate(node)

    def search(self, key: str) -> tuple[Any, int]:
        """Value (None if absent) and the depth it was found at, or the search ended at."""
        node, depth = self._find(key)
        if node is None:
            return None, depth
        self._splay(node)
        return node[_VALUE], depth

    def insert(self, key: str, value: Any) -> None:
        node, _ = self._find(key)
        if node is not None:
            node[_VALUE] = value
            self._splay(node)
            return
        fresh, at = [key, value, None, None, None], self.root
        while at is not None:
            side = _LEFT if key < at[_KEY] else _RIGHT
            if at[side] is None:
                at[side], fresh[_UP], at = fresh, at, None
            else:
                at = at[side]
        if self.root is None:
            self.root = fresh
        self._splay(fresh)
        self.size += 1
        if self.size > self.capacity:
            self.delete(self.deepest()[_KEY])

    def delete(self, key: str) -> bool:
        node, _ = self._find(key)
        if node is None:
            return False
        self._splay(node)
        left, right = node[_LEFT], node[_RIGHT]
        for part in (left, right):
            if part is not None:
                part[_UP] = None
        if left is None or right is None:
            self.root = right if left is None else left
        else:
            self.root = top = left
            while top[_RIGHT] is not None:
                top = top[_RIGHT]
            self._splay(top)
            top[_RIGHT], right[_UP] = right, top
        self.size -= 1
        return True

    def deepest(self) -> list | None:
        """The deepest leaf, the leftmost of several."""
        best, most, stack = None, -1, [(self.root, 0)] if self.root is not None else []
        while stack:
            node, depth = stack.pop()
            if depth > most:
                best, most = node, depth
            stack += [(child, depth + 1) for child in (node[_RIGHT], node[_LEFT]) if child is not None]
        return best

    def peek(self, n: int = 3) -> list[tuple[str, Any]]:
        """Up to n nodes of the three top levels in preorder, without moving any."""
        out, stack = [], [(self.root, 0)] if self.root is not None else []
        while stack and len(out) < n:
            node, depth = stack.pop()
            out.append((node[_KEY], node[_VALUE]))
            if depth < 2:
                stack += [(child, depth + 1) for child in (node[_RIGHT], node[_LEFT]) if child is not None]
        return out

    def keys(self) -> list[str]:
        out, stack, at = [], [], self.root
        while stack or at is not None:
            while at is not None:
                stack.append(at)
                at = at[_LEFT]
            at = stack.pop()
            out.append(at[_KEY])
            at = at[_RIGHT]
        return out


class Session:
    """One session's cache: a hit is the first peeked entry that shares a word with the query (or has its very key)."""

    def __init__(self, capacity: int, peek: int, exact: bool) -> None:
        self.tree, self.peek, self.exact = SplayTree(capacity), peek, exact

    def ask(self, words: Iterable[str], results: Callable[[], list]) -> tuple[bool, list]:
        words = set(words)
        key = " ".join(sorted(words))
        for held, value in self.tree.peek(self.peek) if words else ():
            if held == key if self.exact else words & set(held.split()):
                return True, value
        found = results()
        if found:
            self.tree.insert(key, found)
        return False, found


def simulate(log: DataFrame, capacity: int = 50, peek: int = 3, exact: bool = False) -> DataFrame:
    """Replays (session, seq, words array<string>, results array<string>) in order: session, seq, hit, served.

    results is what exact search gives the query; served is what the cache, or else the search, gave.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = Session(capacity, peek, exact), []
        for r in rows.sort_values("seq").itertuples():
            hit, served = state.ask(r.words, lambda r=r: list(r.results))
            out.append((r.session, r.seq, hit, served))
        return pd.DataFrame(out, columns=["session", "seq", "hit", "served"])

    return log.select("session", "seq", "words", "results").groupBy("session").applyInPandas(fold, "session long, seq long, hit boolean, served array<string>")


def two_level(log: DataFrame, capacity: int = 50, peek: int = 3) -> DataFrame:
    """Replays (session, seq, words, results array<struct<id,tags>>) through the prompt builder's cache: session, seq, hit, served.

    Words of three letters and more count, and they and the tags are compared without case and accents.
    If any peeked entry has a tag among the query's words, or anything is cached and the query has no words, all peeked entries are served and the
    first is looked up, which splays it; else the results are, and each is inserted by its id.
    """
    plain = tx._without_marks

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        tree, out = SplayTree(capacity), []
        for r in rows.sort_values("seq").itertuples():
            top, words = tree.peek(peek), {w for w in map(plain, r.words) if len(w) > 2}
            hit = any(words & set(map(plain, tags)) for _, tags in top) if words else bool(top)
            if hit:
                tree.search(top[0][0])
                served = [key for key, _ in top]
            else:
                served = [x["id"] for x in r.results]
                for x in r.results:
                    tree.insert(x["id"], list(x["tags"]))
            out.append((r.session, r.seq, hit, served))
        return pd.DataFrame(out, columns=["session", "seq", "hit", "served"])

    return log.select("session", "seq", "words", "results").groupBy("session").applyInPandas(fold, "session long, seq long, hit boolean, served array<string>")


def repeats_exactly(log: DataFrame) -> DataFrame:
    """Hits of an exact-key cache without a bound, in SQL terms: a key that came before in its session."""
    key = F.array_join(F.array_sort(F.array_distinct("words")), " ")
    before = F.row_number().over(Window.partitionBy("session", "key").orderBy("seq"))
    return log.withColumn("key", key).select("session", "seq", "key", ((before > 1) & (F.col("key") != "")).alias("hit"))
