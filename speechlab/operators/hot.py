"""Joins of rows to a table of their distinct keys, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.plans.scratch import kept

#: Keys whose entries are broadcast at most: the most frequent ones. Any other key has at most one row in so many.
FREQUENT = 100_000
#: Rows of a key up to which it is shuffled like any other.
HOT_ROWS = 10_000


def join_frequent(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", hot: int = HOT_ROWS, most: int = FREQUENT, *, parts: int | None = None) -> DataFrame:
    """``rows`` inner-joined to ``table``, one row for each key, which counts the key's rows in ``n``.

    Rows of the frequent keys (more than ``hot`` rows, and among the ``most`` most frequent) stay in their partitions, beside
    a broadcast of the keys' entries; all others are shuffled, to ``parts`` tasks if given. Keys are not null; ``n`` is not in the result. Store ``rows``
    and ``table`` first where they are not cheap: both are read for either part.
    """
    columns = [c for c in table.columns if c != n]
    frequent = table.where(F.col(n) > hot).orderBy(F.desc(n), *keys).limit(most)
    deal = lambda some: some.repartition(parts, *keys) if parts else some
    if not frequent.limit(1).count():
        return deal(rows).join(table.select(*columns), keys)
    frequent = kept(frequent.select(*columns))
    near = rows.join(F.broadcast(frequent), keys)
    names = F.broadcast(frequent.select(*keys))
    return near.unionByName(deal(rows.join(names, keys, "left_anti")).join(table.select(*columns).join(names, keys, "left_anti"), keys))
