"""Tables with nulls in every column, empty texts, zero vectors and repeated values, and the same tables without rows."""

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels embeddings pages conversations events".split()
#: Columns that name a row; the others are null in some rows.
KEYS = {"doc_id", "item_id", "vec_id", "page_id", "conv_id", "turn", "event_id", "ts", "user_id", "role"}


def _column(name: str, values: list, kind: pa.DataType) -> pa.Array:
    if name not in KEYS:
        values = [None if i % 9 == 4 else x for i, x in enumerate(values)]
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            values = ["" if i % 9 == 5 else x for i, x in enumerate(values)]
        if pa.types.is_list(kind):
            values = [[0.0] * 64 if i % 9 == 5 else x for i, x in enumerate(values)]
    return pa.array(values, kind)


def write(folder, empty: bool) -> str:
    for name in TABLES:
        table = pq.read_table(f"{SF}/{name}.parquet")
        if empty:
            table = table.slice(0, 0)
        else:
            table = pa.Table.from_arrays([_column(f.name, table.column(f.name).to_pylist(), f.type) for f in table.schema], schema=table.schema)
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)
