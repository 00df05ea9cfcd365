import pytest

from kerbside.session import ship

#: Columns that operators might use for themselves, in any case.
CLASHING = ["key", "ID", "code", "_share", "_hash", "_bucket", "_rank", "rank", "_gone", "u", "v", "f", "k", "label", "family", "score", "_number", "_shard"]


@pytest.fixture
def frame(spark):
    """Documents (doc_id, text, lang, source, n_chars) with columns of clashing names, from (doc_id, text[, source])."""
    ship(spark)

    def make(rows):
        full = [(i, t, "en", (more or ["s"])[0], len(t or ""), *(["x"] * len(CLASHING))) for i, t, *more in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING))

    return make


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
