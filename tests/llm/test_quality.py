"""The fit of the classifier: what its one task holds, and that packing changes nothing."""

import numpy as np
import pyarrow as pa

from plumbline.llm import quality


def labelled(n):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma,", "7", "the", "the"], rng.integers(0, 400))) + " " + hex(rng.integers(1 << 60)) for _ in range(n)]
    return texts, rng.integers(0, 2, n), [f"{i % (n - 5):032x}" for i in range(n)], [1 + (i >= n - 5) for i in range(n)]


def pack(columns):
    return pa.Table.from_batches(quality.pack_rows([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text", "label", "order", "tie"])]))


def plain_fit(texts, labels):
    z, n = np.zeros(quality.SLOTS + 1), np.zeros(quality.SLOTS + 1)
    rows = [(s[a:b], v[a:b]) for _, at, s, v in quality.features(pa.array(texts, pa.large_string())) for a, b in zip(at[:-1], at[1:])]
    for _ in range(quality.EPOCHS):
        for (slots, values), label in zip(rows, labels):
            x = np.zeros(quality.SLOTS + 1)
            np.add.at(x, np.append(slots, quality.SLOTS), np.append(values, 1.0))
            at = np.unique(np.append(slots, quality.SLOTS))
            w = quality._weights(z[at], n[at])
            g = (quality._sigmoid(w @ x[at]) - label) * x[at]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / quality.ALPHA * w
            n[at] += g * g
    return quality._weights(z, n)


def test_packed_rows_fit_like_whole_texts():
    columns = labelled(40)
    order = sorted(range(40), key=lambda i: (columns[2][i], columns[3][i]))
    want = plain_fit([columns[0][i] for i in order], [columns[1][i] for i in order])
    assert np.allclose(quality.fit(pack(columns)), want)


def test_the_fit_holds_few_bytes_a_feature():
    rng = np.random.default_rng(6)
    texts = [" ".join(str(x) for x in rng.integers(0, 5000, 300)) for _ in range(50)]
    rows = pack((texts, [0, 1] * 25, [f"{i:032x}" for i in range(50)], [1] * 50))
    assert rows.column_names == ["order", "tie", "label", "n", "features"]  # no texts
    assert rows.column("features").nbytes < 8 * sum(rows.column("n").to_pylist())
