"""Fixtures and brute-force versions for the training-data operators."""

import numpy as np
import pyarrow.parquet as pq

TABLES = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, other white space, repeated rows and ids, long words.
ODD_TEXTS = [
    (1, "the quick brown fox"), (2, None), (3, ""), (4, " \t\n "), (5, "one"), (5, "two words"),
    (None, "no id here at all"), (7, "The quick brown fox"), (7, "The quick brown fox"),
    (8, "wide space and more  double\r\nlines \x0b end "), (9, "x" * 5000), (10, "null\x00inside it"),
    (11, "naïve café ÄÖÜ 日本語 🙂 don't 12345 <|endoftext|> tail"), (None, None), (12, "\nleading and trailing\n"),
]


def odd_documents(spark):
    """Odd rows with additional columns whose names the operators use themselves."""
    more = "_text _base _random _mark _source _whole _last _uses _use spans text_bytes base tokens mark of whole last uses use merged".split()
    rows = [(i, t, "a", f"s{k % 3}", 0, 1, "x", 2.0, *[k] * len(more)) for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, key string, size double, "
        + ", ".join(f"`{c}` int" for c in more)
    ).repartition(3)


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def read(name, folder=TABLES):
    return pq.read_table(f"{folder}/{name}.parquet").to_pandas()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


class Groups:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vector string, n int")


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)
