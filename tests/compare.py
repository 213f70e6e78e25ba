"""Equal rows, whatever their order; numbers by value."""

import pandas as pd

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype.kind in "iub":
            frame[c] = frame[c].astype("float64")
        elif frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: v if v is None or isinstance(v, str) else float(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def same(df, relation) -> None:
    got, want = df.toPandas(), relation.df()
    assert sorted(got.columns) == sorted(want.columns)
    made = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == made
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, check_exact=True)
