import pytest

#: Names that the operators use inside.
CLASHING = ["label", "slice", "key", "size", "digest", "rank", "shard", "slot", "copy", "times", "v", "u", "score", "shared", "cell"]


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, source) with further columns of awkward names."""

    def make(rows):
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"doc_id long, text string, source string, {extra}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and white texts, a very long one, copies, repeated rows."""
    long = " ".join(f"word{k % 5003} x{k}" for k in range(30_000))
    return [(1, "a b c d e f g", "s1"), (2, "a  b c\td e f g", "s2"), (3, None, "s1"), (4, "", None), (5, " \n\t ", "s1"), (6, long, "s2"), (7, long, "s1"), (None, "no id here at all", "s1"), (8, "a b", None), (9, "a b", "s3"), (9, "a b", "s3"), (10, "ünï cödé  x  y 🙂 end", "s1")]
