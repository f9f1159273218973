"""Postings of documents, folded document by document: what a task holds is a slice of texts and its postings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from lodeseek.session import ship

#: Bytes of texts (or cells) that are folded at once; a document's rows are never parted.
SLICE = 4 << 20


def _pieces(batches, most: int) -> Iterator:
    """The same rows in pieces of about ``most`` bytes that each hold all rows of their ids; equal ids lie together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            ids = piece.column(0).dictionary_encode(null_encoding="encode").indices
            last = piece.num_rows - pc.value_counts(ids).field("counts")[-1].as_py()
            if held and last == 0 and held[-1].column(0)[-1].as_py() == piece.column(0)[0].as_py():
                held.append(piece)
                continue
            whole = [*held, piece.slice(0, last)]
            if any(x.num_rows for x in whole):
                yield pa.concat_batches(whole)
            held = [piece.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _tokens(column, field: int):
    """(row, term, field, pos) of a column: texts, cut at single spaces, or arrays of (term, field, pos)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        lists = pc.split_pattern(pc.fill_null(column, ""), " ")
        ends = np.asarray(lists.offsets)
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        said = np.asarray(pc.not_equal(flat, ""))
        row = np.repeat(np.arange(len(lists)), np.diff(ends))[said]
        before = np.concatenate(([0], np.cumsum(said)))[ends[:-1] - ends[0]]
        return row, flat.filter(pa.array(said)), np.full(len(row), field, np.int32), np.arange(len(row)) - before[row], None
    row, cells = np.asarray(pc.list_parent_indices(column)), pc.list_flatten(column)
    pos = cells.field("pos")
    return row, cells.field("term"), np.asarray(cells.field("field")), np.asarray(pc.fill_null(pos, 0)), np.asarray(pc.is_valid(pos))


def _fold(piece, fields: int, placed: int | None, texts: list[int]):
    """Columns by name: doc_id, term, n, first, last, positions and f0, f1, ... of one piece, in order of terms."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = piece.column(0)
    codes = np.asarray(ids.dictionary_encode(null_encoding="encode").indices)
    heads = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1))
    run = np.zeros(len(codes), np.int64)
    run[heads[1:]] = 1
    run = np.cumsum(run)
    found = [_tokens(piece.column(k + 1), k) for k in range(piece.num_columns - 1)]
    rows, field, pos = (np.concatenate([f[i] for f in found]) for i in (0, 2, 3))
    if not len(rows):
        return None
    valid = np.concatenate([np.ones(len(f[0]), bool) if f[4] is None else f[4] for f in found])
    terms = pa.concat_arrays([f[1].cast(pa.string()) for f in found]).dictionary_encode()
    by_term = np.asarray(pc.sort_indices(terms.dictionary))
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    key = rank[np.asarray(terms.indices)] * len(heads) + run[rows]
    order = np.argsort(key, kind="stable")
    key, field, pos, valid = key[order], field[order], pos[order], valid[order]
    same = np.diff(key) == 0
    if (same & (np.diff(pos) < 0)).any():  # several rows or fields, or a tokenizer that goes back
        order = np.lexsort((pos, key))
        field, pos, valid = field[order], pos[order], valid[order]
    starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
    at = key[starts]
    out = {
        "doc_id": ids.take(pa.array(heads[at % len(heads)])),
        "term": terms.dictionary.take(pa.array(by_term[at // len(heads)])),
        "n": np.add.reduceat(np.isin(field, texts).astype(np.int64), starts),
        "first": pos[starts],
        "last": pos[np.concatenate((starts[1:], [len(pos)])) - 1],
    }
    if fields > 1:
        out |= {f"f{k}": np.maximum.reduceat((field == k).astype(np.int64), starts) for k in range(fields)}
    else:
        out["f0"] = np.ones(len(starts), np.int64)
    if placed is not None:
        kept = (field == placed) & valid
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(kept.astype(np.int64), starts))))
        out["positions"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[kept], pa.int32()))
    return out


def folded(rows: DataFrame, names: list[str], fields: int = 1, placed: int | None = None, texts: tuple[int, ...] = (0,), cells: list[Column] | None = None) -> DataFrame:
    """``names`` of one row per (doc_id, term): doc_id, term, n (cells in ``texts``), first and last (positions), f0, f1,
    ... (1 where that field holds the term, else 0), positions (sorted, of the field ``placed``).

    ``rows`` has doc_id, then, or in ``cells`` made of its columns, texts (the tokens of field 0, 1, ...) or arrays of
    (term, field, pos).  Texts are dealt once,
    before they are cut into tokens, and sorted by document, so that rows of one document meet; tokens are neither shuffled nor
    sorted nor hashed but within slices of ``SLICE`` bytes, so what a task holds does not grow with the input.  A slice's
    postings come in order of terms, which later shuffles and files compress well."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(rows.sparkSession)
    of = {"doc_id": rows.schema["doc_id"].dataType, "term": T.StringType(), "positions": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(n, of.get(n, T.LongType())) for n in names])
    arrow, texts = to_arrow_schema(schema), list(texts)

    def run(batches):
        import pyarrow as pa

        for piece in _pieces(batches, SLICE):
            out = _fold(piece, fields, placed, texts)
            if out is not None:
                columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name]) for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    return (dealt if cells is None else dealt.select("doc_id", *cells)).mapInArrow(run, schema)
