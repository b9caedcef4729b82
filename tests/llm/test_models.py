"""Toxicity, media and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import media, near, queries, secrets, toxic


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of two languages; toxic ones hold a word of their language's list, in one of several forms."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    words = [word() for _ in range(300)]
    rows = []
    for i in range(1200):
        text = list(rng.choice(words, 40))
        if i % 5 == 0:
            text[int(rng.integers(40))] = f"{'vile' if i % 2 else 'crud'}{rng.choice(['', 'xa', 'xo', 'xy'])}"
        rows.append((i, " ".join(text), "en" if i % 2 else "de", int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").cache()
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int").cache()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_learns_and_leaves_held_out_labels(spark, labelled):
    docs, labels = labelled
    p = toxic.Params(bits=12, epochs=8)
    sample = toxic.sample(docs, labels, p)
    assert sample and not any(held_out(r["doc_id"]) for r in sample)
    model = toxic.train(docs, labels, p)
    rows = [r for r in toxic.score(docs.join(labels, "doc_id"), model).collect() if held_out(r["doc_id"])]
    assert np.mean([(r["score"] >= 0.3) == bool(r["toxic"]) for r in rows]) > 0.97
    assert np.mean([r["rejected"] == bool(r["toxic"]) for r in rows]) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxic.train(docs, flipped, p)
    assert (again.kernel == model.kernel).all() and again.thresholds == model.thresholds


def test_learns_from_labels_beyond_the_start(spark, labelled, monkeypatch):
    """Before, the model and its thresholds came from the first few labels alone."""
    docs, labels = labelled
    monkeypatch.setattr(toxic, "PART_ROWS", 300)
    p = toxic.Params(bits=12, per_class=10, epochs=8, passes=8)
    drawn = [r["doc_id"] for r in toxic.sample(docs, labels, p)]
    assert len(drawn) == 30
    rest = docs.join(labels, "doc_id").where("toxic = 1").where(~F.col("doc_id").isin(drawn)).select("doc_id")
    said = docs.join(rest.withColumn("rest", F.lit(True)), "doc_id", "left").withColumn("text", F.when(F.col("rest"), F.concat("text", F.lit(" seldom"))).otherwise(F.col("text"))).drop("rest")
    model = toxic.train(said, labels, p)
    low, high = model.scores([toxic.word_hashes("a few words"), toxic.word_hashes("a few seldom words")])
    assert high > low + 0.1
    assert model.thresholds[""] != 0.5  # that of a sample with too few rows of either label
    again = toxic.train(said.repartition(7), labels, p)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True)) and again.thresholds == model.thresholds


def test_moves_are_averaged_over_the_parts_that_moved():
    move = lambda part, n, at, moved: {"name": "table0", "block": 0, "part": part, "n": n, "at": np.array(at, np.int32).tobytes(), "moved": np.array(moved, np.float32).tobytes()}
    out = toxic._averaged(pa.Table.from_pylist([move(1, 3, [2, 5], [[4, 0], [1, 1]]), move(0, 1, [2, 7], [[0, 8], [2, 3]])])).to_pylist()[0]
    assert np.frombuffer(out["at"], np.int32).tolist() == [2, 5, 7]
    assert np.frombuffer(out["moved"], np.float32).tolist() == [3, 2, 1, 1, 2, 3]


def test_thresholds_by_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(("en", "de", None, "few")[min(i % 4, 3)], round(float(np.clip(rng.normal(0.3 + 0.3 * (i % 3 == 0), 0.2), 0, 1)), 2), int(i % 3 == 0)) for i in range(400)] + [("one", 0.5, 1)] * 5
    got = toxic.thresholds(spark.createDataFrame(rows, "_lang string, score double, _toxic int"), 30)

    def best(own):
        cuts = sorted({s for s, _ in own} | {0.0}, reverse=True)
        caught = {s: sum(y for x, y in own if x >= s) for s in cuts}
        f1 = {s: 2 * caught[s] / (sum(x >= s for x, _ in own) + sum(y for _, y in own)) for s in cuts[:-1]}
        widest = max((s - after, s) for s, after in zip(cuts, cuts[1:], strict=False) if f1[s] >= max(f1.values()) - 1e-12)
        return round(widest[1] - widest[0] / 2, 6)

    assert set(got) == {"", "en", "de", "few"}
    for name, limit in got.items():
        assert limit == pytest.approx(best([r[1:] for r in rows if not name or r[0] == name]))


def test_score_is_of_the_text_alone(spark, labelled):
    docs, labels = labelled
    model = toxic.train(docs, labels, toxic.Params(bits=12, epochs=2))
    rows = [(1, "vile " * 50, "en", "x"), (2, "vile " * 50, "de", "y"), (None, "vile " * 50, None, None), (3, None, "en", "x"), (4, "", "xx", "x"), (5, "word " * 50_000, "en", "x"), (3, None, "en", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = toxic.score(odd, model).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    same = {r["score"] for r in out if r["text"] and r["text"].startswith("vile")}
    assert len(same) == 1
    kept = toxic.drop(odd, model)
    assert kept.columns == odd.columns and all(r["score"] in ("x", "y", None) for r in kept.collect())
    none = toxic.train(docs, labels.where("toxic = 0"))
    assert none is None and {r["score"] for r in toxic.score(odd, none).collect()} == {0.0}
    assert toxic.train(docs.limit(0), labels.limit(0)) is None


def test_convolution_by_loops():
    p = toxic.Params(bits=6, size=3, widths=(1, 2, 3), filters=2)
    model = toxic.Model.fresh(p)
    texts = [np.arange(5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(0, np.uint64), np.array([7], np.uint64)]
    got = model.forward(texts)["score"]
    for t, score in zip(texts, got, strict=True):
        rows = model.rows(t)
        x = np.vstack([sum(table[r] for table, r in zip(model.tables, rows, strict=True)), np.zeros((6, p.size), np.float32)])
        pooled = [max(sum(x[i + w] @ model.kernel[w * p.size : (w + 1) * p.size, f] for w in range(3)) for i in range(len(t) + 3)) + model.biases[f] for f in range(6)]
        want = 1 / (1 + np.exp(-(np.maximum(pooled, 0) @ model.out + model.bias)))
        assert score == pytest.approx(want, rel=1e-4)


def test_toxic_query(spark, data):
    rows = queries.op7_toxicity(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def brute_feature(payload: bytes):
    """The feature by plain loops and textbook formulas, in double precision."""
    up, down, half, size, hop, rate = 3, 4, 8, 128, 64, 6000
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = np.arange(-half * up, half * up + 1)
    taps = np.sinc(n / down) * np.hamming(len(n))
    weights = [taps[r::up].sum() for r in range(up)]
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    whole = np.convolve(stuffed, taps)[half * up :]
    y = np.array([whole[k * down] / weights[k * down % up] for k in range(-(-len(x) * up // down))])
    frames = max(1, -(-(len(y) - size) // hop) + 1)
    y = np.concatenate([y, np.zeros(frames * hop + size)])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), media.MELS + 2) / 2595) - 1)
    bank = np.zeros((media.MELS, size // 2 + 1))
    for m in range(media.MELS):
        for b in range(size // 2 + 1):
            f = b * rate / size
            bank[m, b] = max(0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1])))
        if not bank[m].any():
            bank[m, int(np.rint(edges[m + 1] * size / rate))] = 1
    window = np.hanning(size)
    cut = [y[k * hop : k * hop + size] * window for k in range(frames)]
    rows = np.log([bank @ np.abs(np.fft.rfft(c)) ** 2 + 1e-6 for c in cut])
    energy = np.array([10 * np.log10((c * c).mean() + 1e-6) for c in cut])
    low, high = energy >= energy.max() - 6, energy >= energy.max() - 3
    found, start = [], None
    for k in range(frames + 1):
        if k < frames and low[k]:
            start = k if start is None else start
        elif start is not None:
            if high[start:k].any():
                found.append((start * hop / rate, (k - 1) * hop / rate + size / rate))
            start = None
    count = -(-frames // media.FRAMES)
    tensors = np.full((count * media.FRAMES, media.MELS), np.log(1e-6))
    tensors[:frames] = rows
    spans = [(k * media.FRAMES * hop / rate, (min(frames, (k + 1) * media.FRAMES) - 1) * hop / rate + size / rate) for k in range(count)]
    return tensors.reshape(count, media.FRAMES, media.MELS), spans, found


def test_media_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op8_media(spark, data).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        wave = media.write_wave(payload)
        want = len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wave), hashlib.sha256(wave).hexdigest()
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
        tensors, spans, found = brute_feature(payload)
        f = media.analyse(payload, media.RATE)
        stored, times = media.unpack(media.pack(f.tensors, f.spans))
        # Values agree within single precision; the query's text is that of the values that were stored.
        assert stored.shape == tensors.shape and np.abs(np.exp(stored) - np.exp(tensors)).max() < 1e-3 * np.exp(tensors).max()
        assert np.allclose(times, spans) and len(f.segments) == len(found) and np.allclose(f.segments, found)
        assert r["feature"] == media.feature_text(stored, times, f.segments)


def test_wave_round_trip(spark):
    import io
    import wave

    for text in (None, "", "a", "é" * 100, "x" * 70_000):
        n, payload = media.payload_of(text)
        clip = media.write_wave(payload)
        assert media.read_wave(clip) == (payload, media.RATE) and len(payload) % 64 == 0 and len(payload) >= 64 and n == len((text or "").encode())
        with wave.open(io.BytesIO(clip)) as w:
            assert w.readframes(w.getnframes()) == payload and (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE)
    with pytest.raises(ValueError, match="clip"):
        media.read_wave(b"none")
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "doc_id long, text string")
    rows = media.round_trip(docs).collect()
    assert rows[0][2:] == rows[1][2:]
    out = media.extract(media.store(docs).unionByName(spark.createDataFrame([(4, None, None)], "doc_id long, text string, media binary"))).collect()
    stored = [media.unpack(r["tensors"]) for r in out]
    assert [t.shape for t, _ in stored] == [(1, media.FRAMES, media.MELS)] * 3 + [(0, media.FRAMES, media.MELS)] and [len(s) for _, s in stored] == [1, 1, 1, 0]
    clash = media.store(docs.withColumn("segments", F.lit(1)), media="media").withColumn("tensors", F.lit("t"))
    again = media.extract(clash)
    assert again.count() == 3 and dict(again.dtypes)["tensors"] == "binary" and media.extract(clash.limit(0)).count() == 0


def test_features():
    rate, seconds = 8000, np.arange(16000) / 8000
    tone = np.where((seconds > 0.5) & (seconds < 1.0), np.sin(2 * np.pi * 440 * seconds), 0)
    f = media.analyse((tone * 120 + 128).astype(np.uint8).tobytes(), rate)
    assert len(f.segments) == 1 and f.segments[0][0] == pytest.approx(0.5, abs=0.05) and f.segments[0][1] == pytest.approx(1.0, abs=0.05)
    loud = f.mel[len(f.mel) // 3]
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 3000 / 700), media.MELS + 2) / 2595) - 1)
    assert edges[loud.argmax()] < 440 < edges[loud.argmax() + 2]
    x = np.random.default_rng(1).standard_normal(300).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 1), (1, 1)):
        table, half = media.phases(up, down, 4), 4
        width = table.shape[1]
        padded = np.concatenate([np.zeros(width // 2), x, np.zeros(width)])
        want = [sum(padded[k * down // up + j] * table[k * down % up, width - 1 - j] for j in range(width)) for k in range(-(-300 * up // down))]
        assert media.resample(x, up, down, half) == pytest.approx(np.array(want), abs=1e-4)
    with pa.ipc.open_stream(media.pack(f.tensors, f.spans)) as reader:
        stored = reader.read_all()
    array = stored.column("tensor").chunk(0)
    assert isinstance(array, pa.FixedShapeTensorArray) and array.type.shape == [media.FRAMES, media.MELS]
    assert (array.to_numpy_ndarray() == f.tensors).all() and stored.column("end_s").to_pylist() == [b for _, b in f.spans]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties, further columns and empty tables, through every stage."""
    long = "word " * 60_000
    secret = "keep this text with its many plain words and token = abcdefghijklmnop0123 in it"
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, secret), (5, secret), (None, "a row without an id has text of its own to keep"), (6, "one two three four five six seven eight nine ten and more"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _toxic int, class_id string")
    labels, items = spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items), ("none/documents", docs.limit(0)), ("none/labels", labels.limit(0)), ("none/benchmark", items.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    after, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, after, str(tmp_path)).cache()
        kept[name] = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect())
        if name != "byte_bpe":
            assert out.columns == docs.columns
            after = out
    assert kept["toxicity"] == [-1, 1, 2, 3, 4, 5, 5, 6, 7] and kept["near_duplicates"] == [-1, 1, 2, 3, 5, 6, 7]
    assert kept["decontamination"] == kept["secrets"] == kept["byte_bpe"] == [-1, 1, 2, 3, 5, 7]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert texts[5][0].endswith("token = [SECRET] in it") and texts[5][1] == len(texts[5][0]) and texts[1] == (None, None) and texts[3] == (long, len(long))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["n_tokens"] for r in result.collect()}[2] == 0 and result.count() == 6
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark, data):
    """Every stage's decision, against brute force on its own input."""
    from tests.llm.test_texts import brute_hits

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        rows = out.collect()
        after = {r["doc_id"]: r["text"] for r in rows} if name != "byte_bpe" else {}
        if name != "byte_bpe":
            assert out.columns == docs.columns and set(after) <= set(before)
        if name == "toxicity":
            model = toxic.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
            assert set(after) == {r["doc_id"] for r in toxic.score(docs, model).collect() if not r["rejected"]}
        elif name == "near_duplicates":
            idf = near.document_frequencies(docs, "text")
            known = {i: near.shingles(near.word_hashes(near.words_of(t)), idf) for i, t in before.items()}
            for gone in set(before) - set(after):
                assert max(near.similarity(known[gone], known[i]) for i in before if i != gone) >= 0.8
            left = sorted(after)
            assert not any(near.similarity(known[a], known[b]) >= 0.8 for a in left for b in left if a < b)
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not brute_hits(t, bench)[4]}
        elif name == "secrets":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not any(secrets.base_spans(secrets.flat(t)) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not re.search(r"[0-9a-f]{8}|[A-Z]{4}|\d", t))
        else:
            assert {r["doc_id"] for r in rows} == set(before)
            assert all(r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest() for r in rows)
        docs, before = out, after
    assert corpus_pipeline.run(spark, data).count() == docs.count()
