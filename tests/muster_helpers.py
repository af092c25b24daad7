"""What several test modules use; a module name that no other folder of tests has."""

import datetime as dt

SMOKE_DIR = "/root/testdata/sf0.001"


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
