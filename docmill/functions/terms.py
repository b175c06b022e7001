"""Groups of terms in one Aho-Corasick automaton: a text is scanned once, whatever the number of terms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.batches import slices


def automaton(groups: dict[str, tuple[str, ...]]):
    """An automaton whose words say which groups they are of, a bit each in the order of ``groups``."""
    import ahocorasick

    bits: dict[str, int] = {}
    for i, terms in enumerate(groups.values()):
        for t in terms:
            bits[t] = bits.get(t, 0) | 1 << i
    made = ahocorasick.Automaton()
    for term, b in bits.items():
        made.add_word(term, b)
    made.make_automaton()
    return made


def scanned(df: DataFrame, texts: dict[str, str], groups: dict[str, tuple[str, ...]], drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows, less the columns in ``drop``, with a long for each text column: {text column: new column}. Bit i says whether the text holds a term of group i; null holds none.

    Terms that overlap or lie in one another all count. A text is left as soon as all groups are found.
    """
    left = [c for c in df.columns if c not in drop]
    schema = T.StructType([*df.select(*left).schema.fields, *[T.StructField(n, T.LongType(), False) for n in texts.values()]])

    def run(batches):
        scan, every = automaton(groups).iter, (1 << len(groups)) - 1

        def bits(text: str | None) -> int:
            out = 0
            for _, b in scan(text or ""):
                out |= b
                if out == every:
                    break
            return out

        for b in slices(batches):
            at = {n: i for i, n in enumerate(b.schema.names)}
            made = [pa.array([bits(x) for x in b.column(at[c]).to_pylist()], pa.int64()) for c in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in left), *made], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def holds(bits: Column, groups: dict[str, tuple[str, ...]], *names: str) -> Column:
    """Whether a column of :func:`scanned` has any of the named groups."""
    mask = sum(1 << list(groups).index(n) for n in names)
    return bits.bitwiseAND(mask) != 0
