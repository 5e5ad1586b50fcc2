"""Embedding by a port: a function from a list of texts to a list of vectors, called in small groups inside the tasks.

Nothing raises for a single text: each row has a status, ``ok``, ``zero`` (blank text, or a vector of zeros or none came
back) or ``failed`` (the port raised), and a row that isn't ``ok`` has a vector of zeros.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Port = Callable[[list[str]], Sequence[Sequence[float] | None]]
#: Longest text of a search and of the queue, in characters; texts of one call; seconds before another try, least and most.
SEARCH_LENGTH, QUEUE_LENGTH, GROUP, LEAST_WAIT, MOST_WAIT = 8000, 4000, 10, 2.0, 10.0
#: So many calls in a row that fail for the network's sake, each after all its attempts, and a task asks no more: the service is down.
MOST_DOWN, DOWN = 3, "unreachable: "


def call(port: Port, texts: list[str], attempts: int, wait: float) -> tuple[list, str | None]:
    """The port's vectors, or none and the error. Only failures of the network or the file system are tried again."""
    for turn in range(attempts):
        try:
            found = list(port(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(texts)} texts, {len(found)} vectors")
            return found, None
        except OSError as e:
            error = f"{DOWN}{type(e).__name__}: {e}"
            if turn + 1 < attempts:
                time.sleep(min(wait * 2**turn, MOST_WAIT))
        except Exception as e:  # noqa: BLE001: a port may raise anything; the row says what
            return [None] * len(texts), f"{type(e).__name__}: {e}"
    return [None] * len(texts), error


def embed(df: DataFrame, column: str, port: Port, dim: int, most: int = QUEUE_LENGTH, group: int = GROUP, attempts: int = 3, wait: float = LEAST_WAIT) -> DataFrame:
    """``df`` with ``embedding`` (array of ``dim`` floats), ``embed_status`` and ``embed_error`` (200 characters at most).

    If a group fails, its texts are asked for one by one, so that one bad text spoils no other.  After MOST_DOWN calls in a row that the network
    failed, the rest of the task's texts are ``failed`` without being asked for, so a dead service costs seconds and not hours.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_status", T.StringType()), T.StructField("embed_error", T.StringType())])

    def run(batches):
        down = 0

        def ask(some: list[str]) -> tuple[list, str | None]:
            nonlocal down
            if down >= MOST_DOWN:
                return [None] * len(some), f"not asked: {down} calls in a row failed"
            found, error = call(port, some, attempts, wait)
            down = down + 1 if error is not None and error.startswith(DOWN) else 0
            return found, error

        for batch in batches:
            texts = [(t or "").strip()[:most] for t in batch.column(column).to_pylist()]
            vectors, errors = [None] * len(texts), [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(full), group):
                some = full[at : at + group]
                found, error = ask([texts[i] for i in some])
                if error and len(some) > 1:
                    alone = [ask([texts[i]]) for i in some]
                    found, failed = [f[0] for f, _ in alone], [e for _, e in alone]
                else:
                    failed = [error] * len(some)
                for i, f, e in zip(some, found, failed):
                    vectors[i], errors[i] = f, e
            good = [v is not None and len(v) == dim and any(v) for v in vectors]
            for i, v in enumerate(vectors):
                if v is not None and len(v) not in (0, dim):
                    errors[i] = f"{len(v)} numbers, {dim} wanted"
            status = ["failed" if e else "ok" if g else "zero" for g, e in zip(good, errors)]
            out = [list(map(float, v)) if g else [0.0] * dim for g, v in zip(good, vectors)]
            extra = [pa.array(out, pa.list_(pa.float32())), pa.array(status, pa.string()), pa.array([e and e[:200] for e in errors], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema.names)

    return df.mapInArrow(run, schema)


def statistics(embedded: DataFrame) -> DataFrame:
    """One row: total, success, failed, zero_vectors."""
    which = {"success": "ok", "failed": "failed", "zero_vectors": "zero"}
    return embedded.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("embed_status") == s).alias(name) for name, s in which.items()])
