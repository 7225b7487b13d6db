"""Replicated texts packed as runs: (doc_id, node, first, step, chars, removed), nodes of one replica at the ticks first,
first + step, ... with a character each; removed is null (none is) or has 0 or 1 for each character.

A node as a row takes some ten times its character's bytes in a shuffle; a run takes little more than its text. Runs of a text meet in
one task and are merged there, many texts at a time; a text must fit a task's memory. Where runs are made of a table's rows,
these are brought together first (``together``): they are less than what is made of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Characters of the runs that are merged at once, in whole texts.
CHARS = 1 << 18
SCHEMA = "node STRING, first BIGINT, step BIGINT, chars STRING, removed STRING"


def _codes(column) -> tuple:
    """Code points of all strings of an Arrow column without nulls, and their number in each."""
    import numpy as np
    import pyarrow.compute as pc

    data = "".join(column.to_pylist())
    return np.frombuffer(data.encode("utf-32-le"), np.uint32), pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _strings(codes, lengths):
    """An Arrow column of strings: the next ``lengths[i]`` of ``codes`` each."""
    import numpy as np
    import pyarrow as pa

    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def merged(runs) -> tuple:
    """Live nodes of an Arrow table of runs, whose texts' rows are adjacent: row of the text's first run, tick, names' places,
    code point, in the order of texts, ticks and names; and the names. A node of several runs has its greatest
    character, and is removed if any says so."""
    import numpy as np
    import pyarrow.compute as pc

    n = runs.num_rows
    ids = pc.rank(runs["doc_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    text = np.maximum.accumulate(np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), np.arange(n), 0))
    codes, sizes = _codes(runs["chars"].combine_chunks())
    row = np.repeat(np.arange(n), sizes)
    tick = runs["first"].to_numpy()[row] + runs["step"].to_numpy()[row] * (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    names = sorted(set(runs["node"].to_pylist()), key=lambda s: s.encode())
    place = {s: i for i, s in enumerate(names)}
    name = np.array([place[s] for s in runs["node"].to_pylist()], np.int64)[row]
    gone = np.zeros(len(codes), bool)
    flagged = pc.is_valid(runs["removed"]).to_numpy()
    if flagged.any():
        gone[flagged[row]] = np.frombuffer("".join(runs["removed"].drop_null().to_pylist()).encode(), np.uint8) == ord("1")
    order = np.lexsort((name, tick, text[row])) if len(codes) else np.zeros(0, np.int64)
    text, tick, name, codes, gone = text[row][order], tick[order], name[order], codes[order], gone[order]
    new = np.ones(len(codes), bool)
    new[1:] = (text[1:] != text[:-1]) | (tick[1:] != tick[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    if len(at):
        live = ~np.logical_or.reduceat(gone, at)
        text, tick, name, codes = text[at][live], tick[at][live], name[at][live], np.maximum.reduceat(codes, at)[live]
    return text, tick, name, codes, names


def _whole_texts(batches: Iterator) -> Iterator:
    """Tables of about CHARS characters that end where a text ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, chars = [], 0
    for batch in batches:
        lo, size = 0, pc.fill_null(pc.utf8_length(batch.column("chars")), 0).to_pylist()
        ids = batch.column("doc_id")
        for i in range(batch.num_rows):
            if chars >= CHARS and not (ids[i].equals(ids[i - 1]) if i else ids[0].equals(held[-1].column("doc_id")[-1])):
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                yield pa.Table.from_batches(held)
                held, chars, lo = [], 0, i
            chars += size[i]
        if batch.num_rows > lo:
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def together(rows: DataFrame) -> DataFrame:
    """All rows of a text, by doc_id, one after the other in one task."""
    return rows.repartition("doc_id").sortWithinPartitions("doc_id")


def _dealt(runs: DataFrame, met: bool) -> DataFrame:
    runs = runs.select("doc_id", *(f.split()[0] for f in SCHEMA.split(", ")))
    return runs if met else together(runs)


def texts(runs: DataFrame, met: bool = False) -> DataFrame:
    """(doc_id, text, length) of the live nodes in the order of tick and name; a text without any has no row.

    met: the runs were made, row by row, of rows that ``together`` gave.
    """

    def join(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_texts(batches):
            text, _, _, codes, _ = merged(table)
            rows, n = np.unique(text, return_counts=True)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(pa.array(rows)), _strings(codes, n), pa.array(n, pa.int64())], ["doc_id", "text", "length"])

    return _dealt(runs, met).mapInArrow(join, f"doc_id {runs.schema['doc_id'].dataType.simpleString()}, text string, length long")


def nodes(runs: DataFrame, met: bool = False) -> DataFrame:
    """(doc_id, ts, node, ch, removed) of the live nodes; ``met`` as for ``texts``."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_texts(batches):
            text, tick, name, codes, names = merged(table)
            ids, kinds = table["doc_id"].combine_chunks(), pa.array(names, pa.string())
            for lo in range(0, len(codes), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                one = codes[cut]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[cut])), pa.array(tick[cut], pa.int64()), kinds.take(pa.array(name[cut])), _strings(one, np.ones(len(one), np.int64)), pa.array(np.zeros(len(one), bool))], ["doc_id", "ts", "node", "ch", "removed"])

    return _dealt(runs, met).mapInArrow(rows, f"doc_id {runs.schema['doc_id'].dataType.simpleString()}, ts long, node string, ch string, removed boolean")
