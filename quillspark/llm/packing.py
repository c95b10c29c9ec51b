"""Texts into containers of fixed capacity, by bin completion.

Sizes are token counts of a public tokenizer. Items are dealt to groups of bounded size by their hash; a group is
packed by one task. Each container is built around the largest item left; its undominated fillings are branched on,
those that waste least first. A branch ends where the waste so far is more than a better solution may have, and the
search goes back to the container before and its next filling. The best-fit solution is the first incumbent.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillspark.session import keep, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
#: Items packed by one task, on average; choices looked at for one group, and for one container before more waste is allowed (tried in turn).
GROUP_ITEMS, NODES, EFFORTS = 5000, 800_000, (25, 100, 400, 1600)


def count_tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every text that is not null or empty. `tokenizer` is a rank file of a byte-level BPE that every executor can read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["t"]]})

    rows = spread(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter("t <> ''"), "id")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, tokens bigint").filter("tokens > 0")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each container."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            bisect.insort(room, (left - sizes[i], k))
        else:
            bins.append([i])
            bisect.insort(room, (capacity - sizes[i], len(bins) - 1))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that no solution can do without: for each threshold, items too large to share are counted, and what is left of the others beside them."""
    s = sorted(sizes)
    total = [0]
    for x in s:
        total.append(total[-1] + x)
    best = -(-total[-1] // capacity)
    for k in sorted({x for x in s if 2 * x <= capacity} | {0}):
        big = bisect.bisect_right(s, capacity - k)
        half = bisect.bisect_right(s, capacity // 2)
        low = bisect.bisect_left(s, k)
        n1, n2 = len(s) - max(big, half), max(0, big - half)
        rest = total[half] - total[low] - (n2 * capacity - (total[half + n2] - total[half]))
        best = max(best, n1 + n2 + max(0, -(-rest // capacity)))
    return best


class _Search:
    """Branch and bound over containers: each is filled around the largest item left, by one undominated filling after another, and undone where the waste bound leaves none."""

    def __init__(self, sizes: list[int], capacity: int, nodes: int, effort: int) -> None:
        self.capacity, self.nodes, self.effort = capacity, nodes, effort
        self.count: dict[int, int] = {}
        for x in sizes:
            self.count[x] = self.count.get(x, 0) + 1
        self.have = sorted(self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            self.have.pop(bisect.bisect_left(self.have, s))

    def give(self, s: int) -> None:
        if s not in self.count:
            bisect.insort(self.have, s)
            self.count[s] = 0
        self.count[s] += 1

    def undominated(self, chosen: list[int], slack: int) -> bool:
        """Whether no item left could be added, or take the place of a smaller one."""
        used: dict[int, int] = {}
        for x in chosen:
            used[x] = used.get(x, 0) + 1
        free = lambda k: self.count[self.have[k]] > used.get(self.have[k], 0)
        for x in (0, *used):
            k = bisect.bisect_right(self.have, x)
            while k < len(self.have) and self.have[k] - x <= slack:
                if free(k):
                    return False
                k += 1
        return True

    def sums(self, room: int, top: int, chosen: list[int], least: int, most: int, left: list[int]) -> Iterator[list[int]]:
        """Choices of sizes below place `top` that leave from `least` to `most` of `room`; larger sizes first."""
        if least <= room <= most:
            yield chosen
        if room < least:
            return
        for k in range(bisect.bisect_right(self.have, room - least, 0, top) - 1, -1, -1):
            left[0] -= 1
            self.nodes -= 1
            if left[0] < 0 or self.nodes < 0:
                return
            s = self.have[k]
            again = self.count[s] > chosen.count(s) + 1
            yield from self.sums(room - s, k + 1 if again else k, [*chosen, s], least, most, left)

    def fillings(self, room: int, waste: int) -> Iterator[list[int]]:
        """Undominated fillings that waste no more than `waste`: those without waste first, then in bands of twice the width."""
        least = most = 0
        while True:
            most = min(most, waste)
            for chosen in self.sums(room, len(self.have), [], least, most, [self.effort]):
                if not most or self.undominated(chosen, room - sum(chosen)):
                    yield chosen
            if most >= waste or most >= room:
                return
            least, most = most + 1, 2 * most + 1

    def solve(self, containers: int) -> list[list[int]] | None:
        """Sizes by container, if so many are found to do within the nodes left."""
        waste = containers * self.capacity - sum(x * n for x, n in self.count.items())
        if waste < 0:
            return None
        done: list[list[int]] = []
        waiting: list[Iterator[list[int]]] = []

        def open_next() -> None:
            first = self.have[-1]
            self.take(first)
            done.append([first])
            waiting.append(self.fillings(self.capacity - first, waste))

        open_next()
        while waiting:
            now = done[-1]
            if len(now) > 1 or getattr(self, "_empty", None) is now:  # the filling tried before is taken back
                waste += self.capacity - sum(now)
                for x in now[1:]:
                    self.give(x)
                del now[1:]
                self._empty = None
            chosen = next(waiting[-1], None) if self.nodes >= 0 else None
            if chosen is None:
                waiting.pop()
                self.give(done.pop()[0])
                continue
            for x in chosen:
                self.take(x)
            now += chosen
            waste -= self.capacity - sum(now)
            if not chosen:
                self._empty = now
            if not self.have:
                return done
            open_next()
        return None


def complete(sizes: list[int], capacity: int, nodes: int = NODES, efforts: tuple[int, ...] = EFFORTS) -> list[list[int]]:
    """Containers (positions of items), none over the capacity, every item once.

    The best-fit solution is the first incumbent; solutions of one container less are searched until there is none,
    the lower bound is reached or `nodes` choices have been looked at, beside those on the way down to a first
    solution. `efforts`: how many choices are looked at for a container before more waste is allowed; each is tried in
    turn, for where it pays to use up exact fillings differs. With few items the search is complete.
    """
    incumbent, bound = best_fit(sizes, capacity), lower_bound(sizes, capacity)
    for effort in efforts:
        left = nodes // len(efforts)
        while len(incumbent) > bound and left > 0:
            search = _Search(sizes, capacity, left + 4 * effort * len(incumbent), effort)
            found = search.solve(len(incumbent) - 1)
            left = min(left, search.nodes)
            if found is None:
                break
            at: dict[int, list[int]] = {}
            for i in sorted(range(len(sizes)), reverse=True):
                at.setdefault(sizes[i], []).append(i)
            incumbent = [[at[x].pop() for x in one] for one in found]
    return incumbent


def pack(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, doc_id, piece, start_token, n_tokens): every text with tokens in containers of at most `capacity` tokens.

    A text is split only if it alone exceeds the capacity: into pieces that fill containers of their own, and a rest
    that is packed like an item. Null and empty texts are in no container. Repeated ids are packed as often as they
    occur. Containers are numbered `<group>-<number>`, pieces of own containers `full-<doc_id>-<piece>`.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = keep(count_tokens(docs, doc_id, text, tokenizer), "sizes")
    whole = F.floor(F.col("tokens") / capacity)
    full = sizes.filter(F.col("tokens") > capacity).select(
        "id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece")
    )
    full = full.select(F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.col("id").alias(doc_id), F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("bigint").alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    over = F.col("tokens") > capacity
    items = sizes.select("id", F.when(over, whole).otherwise(0).cast("int").alias("piece"), F.when(over, whole * capacity).otherwise(0).cast("bigint").alias("start"), F.when(over, F.col("tokens") % capacity).otherwise(F.col("tokens")).alias("n")).filter("n > 0")
    groups = max(1, -(-sizes.count() // group_items))
    items = items.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    kind = dict(sizes.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins = complete(pdf["n"].tolist(), capacity)
        where = {i: k for k, one in enumerate(bins) for i in one}
        g = int(pdf["g"].iloc[0])
        return pd.DataFrame({"container": [f"{g}-{where[i]}" for i in range(len(pdf))], doc_id: pdf["id"], "piece": pdf["piece"], "start_token": pdf["start"], "n_tokens": pdf["n"]})

    packed = items.groupBy("g").applyInPandas(run, f"container string, {doc_id} {kind}, piece int, start_token bigint, n_tokens bigint")
    return packed.unionByName(full)
