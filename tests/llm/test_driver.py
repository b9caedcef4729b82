"""What training holds on the driver."""

import gc
import weakref

import numpy as np

from chronoweave.llm import secrets, toxic


class Rows(list):
    """A list that can be referred to weakly."""


def test_toxicity_lets_its_first_rows_go(spark, monkeypatch):
    """Before, the rows that the first fit needs stayed on the driver while all others were learnt from."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} words {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen, rows_of, refine = [], toxic.sample, toxic.refined

    def sample(*a, **b):
        rows = Rows(rows_of(*a, **b))
        seen.append(weakref.ref(rows))
        return rows

    def refined(*a, **b):
        gc.collect()
        seen.append(seen[0]())
        return refine(*a, **b)

    monkeypatch.setattr(toxic, "sample", sample)
    monkeypatch.setattr(toxic, "refined", refined)
    assert toxic.train(docs, labels) is not None
    assert seen[1] is None


def test_secrets_hold_their_pieces_once():
    """Before, each array was copied as one of twice the size beside the rows it came from."""
    packed = [np.array(x, "<i4") for x in ([3, 4, 5, 6, 7, 3, 4], [2, 1, 2, 2], [0, 1, 0, 2], [3, 1])]
    row = dict(zip(("features", "widths", "labels", "lengths"), (x.tobytes() for x in packed), strict=True))
    found = secrets._unpacked([row, row])
    assert [(f.tolist(), w.tolist(), y.tolist()) for (f, w), y in found] == [([3, 4, 5, 6, 7], [2, 1, 2], [0, 1, 0]), ([3, 4], [2], [2])] * 2
    assert all(x.dtype == np.int32 and not x.flags.owndata for (f, w), y in found for x in (f, w, y))
    wide = [((f.astype(np.int64), w.astype(np.int64)), y.astype(np.int64)) for (f, w), y in found]
    a, b = secrets.fit(found), secrets.fit(wide)
    assert (a.weights == b.weights).all() and (a.pairs == b.pairs).all()
