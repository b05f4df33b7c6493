"""How a search keeps to its scope, chosen from the catalog's sizes before a text is read: whole corpora or whole authors by name, a few works by id (filters that
Parquet prunes by), or a semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and ids up to these numbers are written into the scan's filter.
MOST_NAMES, MOST_IDS = 200, 500
#: Ids up to this number (about 20 bytes each) are broadcast in a semi-join.
MOST_BROADCAST_IDS = 1_000_000


def _sizes(catalog: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """column, n of the chosen works, total of all: of the values that chosen works have."""
    total = catalog.groupBy(F.col(column).alias("of")).agg(F.count("*").alias("total"))
    some = chosen.groupBy(column).agg(F.count("*").alias("n"))
    return some.join(total, F.col(column).eqNullSafe(F.col("of"))).select(column, "n", "total")


def way(catalog: DataFrame, chosen: DataFrame) -> tuple[str, list]:
    """all, corpus, author, work or join; and the names or ids to filter by. chosen: rows of the catalog, read more than once, so best a stored table."""
    corpora = _sizes(catalog, chosen, "corpus").limit(MOST_NAMES + 1).collect()
    count = sum(r.n for r in corpora) if len(corpora) <= MOST_NAMES else chosen.count()
    if not count:
        return "work", []
    if len(corpora) <= MOST_NAMES and all(r.corpus is not None and r.n == r.total for r in corpora):
        return ("all", []) if catalog.select("corpus").distinct().count() == len(corpora) else ("corpus", sorted(r.corpus for r in corpora))
    if count <= MOST_IDS:
        return "work", sorted(r.work_id for r in chosen.where("work_id is not null").select("work_id").distinct().collect())
    authors = _sizes(catalog, chosen, "author").where("author is null or n <> total").isEmpty()
    if authors:
        names = [r.author for r in chosen.select("author").distinct().limit(MOST_NAMES + 1).collect()]
        if len(names) <= MOST_NAMES:
            return "author", sorted(names)
    return "join", []


def restricted(works: DataFrame, catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """The works that are chosen."""
    how, names = way(catalog, chosen)
    if how == "all":
        return works
    if how != "join":
        return works.where(F.col({"corpus": "corpus", "author": "author", "work": "work_id"}[how]).isin(names))
    ids = chosen.select("work_id").distinct()
    return works.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids, "work_id", "left_semi")
