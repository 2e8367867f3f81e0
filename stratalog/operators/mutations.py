"""Damage to payloads, as expressions: what readers have to survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(key: Column, kind: str, seed: int, size: Column) -> Column:
    """A place from 1 on that the key, the kind and the seed decide."""
    return (F.pmod(F.xxhash64(key, F.lit(kind), F.lit(seed)), F.greatest(size, F.lit(1))) + 1).cast("int")


def mutations(key: Column, payload: Column, seed: int = 1) -> dict[str, Column]:
    """The payload damaged in ten ways, by name."""
    size = F.length(payload)
    at = lambda kind: _place(key, kind, seed, size)
    head = lambda n: F.substring(payload, F.lit(1), n)
    tail = lambda n: F.substring(payload, n, size)
    raw = lambda h: F.unhex(F.lit(h))
    return {
        "empty": raw(""),
        "cut_tail": head(at("cut_tail") - 1),
        "cut_head": tail(at("cut_head") + 1),
        "byte": F.concat(head(at("byte") - 1), raw("A5"), tail(at("byte") + 1)),
        "zeros": F.concat(head(at("zeros") - 1), raw("00" * 64), tail(at("zeros") + 64)),
        "ones": F.concat(head(at("ones") - 1), raw("FF" * 64), tail(at("ones") + 64)),
        "inserted": F.concat(head(at("inserted")), raw("504B0304504B0102"), tail(at("inserted") + 1)),
        "removed": F.concat(head(at("removed") - 1), tail(at("removed") + 7)),
        "twice": F.concat(payload, payload),
        "swapped": F.concat(tail(at("swapped") + 1), head(at("swapped"))),
    }


def damaged(table: DataFrame, key: str, payload: str = "content", seed: int = 1) -> DataFrame:
    """key, mutation and the payload, ten rows for each row; the same for the same seed."""
    each = F.array(*[F.struct(F.lit(name).alias("mutation"), body.alias(payload)) for name, body in mutations(F.col(key), F.col(payload), seed).items()])
    return table.select(key, F.explode(each).alias("m")).select(key, "m.*")
