import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import cotraining as co
from gridloom.llm import textbytes as tb


@pytest.fixture(scope="module")
def tables(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")


def test_text_view_counts_whole_texts():
    texts = ["", "ab", "abc", "x" * 3_000_000 + "yz", "abcabc", "é"]
    data, offsets = tb.column(pa.array(texts))
    view = co.text_view(data, offsets)
    for k, t in enumerate(texts):
        d, o = tb.column(pa.array([t]))
        assert (co.text_view(d, o)[0] == view[k]).all()
    assert not view[0].any() and not view[1].any() and view[3].max() >= 254


def test_metadata_view_equals_plain_figures():
    texts = ["", "A b b\nA b b\n\nc9!", "é é", "\n\n", "one"]
    data, offsets = tb.column(pa.array(texts))
    none = pa.array([None] * len(texts), pa.string())
    view = co.metadata_view(data, offsets, none, none)
    for k, t in enumerate(texts):
        raw, words, lines = t.encode(), t.split(), t.encode().split(b"\n")
        n = max(1, len(raw))
        want = [sum(65 <= c < 91 for c in raw) / n, sum(48 <= c < 58 for c in raw) / n, sum(c < 128 and chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in raw) / n,
                sum(c >= 128 for c in raw) / n, sum(chr(c).isspace() for c in raw if c < 128) / n, np.log1p(len(raw)), np.log1p(len(words)), len(set(words)) / max(1, len(words)),
                sum(len(w.encode()) for w in words) / max(1, len(words))]
        assert np.allclose(view[k, :9], want, atol=1e-6), t
        if raw and not raw.endswith(b"\n"):
            assert np.allclose(view[k, 9:co.FIGURES], [np.log1p(len(lines)), len(lines) / n, len(set(lines)) / len(lines), max(len(x) + (i < len(lines) - 1) for i, x in enumerate(lines)) / n, len(words) / n], atol=1e-6)


def test_accuracy_on_labels_never_seen(spark, tables):
    docs, labels = tables
    seen = labels.where("doc_id % 2 = 0")
    model = co.fit(docs, seen)
    judged = co.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right, count, lost = judged.selectExpr("avg(cast(kept = (quality = 1) as int))", "count(*)", "avg(cast(quality = 1 and not kept as int))").first()
    assert count > 150 and right > 0.96 and lost < 0.02


def test_rounds_help_when_labels_are_few(spark, tables):
    """A hundred labels to learn from: rounds are kept, exchange labels, and judge rows never seen better than none do."""
    docs, labels = tables
    few = labels.where("xxhash64(doc_id, 5) % 2 = 0").orderBy("doc_id").limit(200)
    unseen = labels.where("xxhash64(doc_id, 5) % 2 <> 0")
    found = {}
    for rounds in (0, 4):
        model = co.fit(docs, few, rounds=rounds)
        loss = "avg(-ln(greatest(1e-6, if(quality = 1, score, 1 - score))))"
        found[rounds] = co.classify(docs, model).join(unseen, "doc_id").selectExpr("avg(cast(kept = (quality = 1) as int))", loss).first()
        if rounds:
            assert model.history and model.history[0].kept and model.history[0].text_labels > 100 and model.history[0].metadata_labels > 100
    assert found[4][0] >= found[0][0] > 0.9 and found[4][1] < 0.5 * found[0][1]


def test_a_round_that_loses_is_undone(spark, tables):
    docs, labels = tables
    model = co.fit(docs, labels, rounds=6)
    kept = [r.kept for r in model.history]
    assert kept and all(kept[:-1]) and any(kept)
    again = co.fit(docs, labels, rounds=sum(kept))
    assert np.allclose(model.text.weight, again.text.weight) and np.allclose(model.mix, again.mix)


def test_fit_equals_a_plain_run(spark, tables):
    """All of ``fit`` again with NumPy on collected views."""
    docs, labels = tables
    model = co.fit(docs, labels, seed=60, rounds=2)
    gold = labels.where("quality is not null").groupBy("doc_id").avg("quality").selectExpr("doc_id as id", "cast(`avg(quality)` >= 0.5 as double) as label")
    rows = co.views(docs).join(gold, "id", "left").selectExpr("*", "xxhash64(id) as key").toPandas()
    view = lambda r: (np.stack([np.frombuffer(v, np.uint8) for v in r.text_view]) / 255.0, np.stack([np.frombuffer(v, np.float32) for v in r.metadata_view]).astype(float))
    known, other = rows[rows.label.notna()].drop_duplicates("id").sort_values(["key", "id"]), view(rows[rows.label.isna()])
    x, y = view(known), known.label.to_numpy()
    place = np.arange(len(y))
    learn = place < 60
    level, judge = (~learn & (place % 2 == k) for k in (0, 1))

    def made(text, metadata):
        m = co._calibrated(text, metadata, (x[0][level], x[1][level]), y[level])
        p = np.clip(m.scores(x[0][judge], x[1][judge])[2], 1e-6, 1 - 1e-6)
        return m, -np.where(y[judge] > 0, np.log(p), np.log(1 - p))

    best, loss = made(co.View.fit(x[0][learn], y[learn]), co.View.fit(x[1][learn], y[learn]))
    edge = np.log(19)
    for _ in range(2):
        views = (best.text, best.metadata)
        judges = best.logits(*other)[::-1]  # the other view's
        tried = []
        for damping in (0.5, 0.125, 0.03125):
            moved = []
            for k, v in enumerate(views):
                slope, curve = v.ridge * v.weight, v.ridge * np.ones(len(v.weight))
                sure = np.abs(judges[k]) >= edge
                for rows_, labels_ in ((x[k][learn], y[learn]), (other[k][sure], (judges[k][sure] > 0) * 1.0)):
                    z = v.columns(rows_)
                    p = 1 / (1 + np.exp(-np.clip(z @ v.weight, -30, 30)))
                    if len(z):
                        slope, curve = slope + z.T @ (p - labels_) / len(z), curve + ((z**2).T @ (p * (1 - p))) / len(z)
                moved.append(co.View(v.mean, v.scale, v.weight - damping * slope / curve, v.ridge))
            tried.append(made(*moved))
        model_, after = min(tried, key=lambda t: t[1].mean())
        if after.mean() > loss.mean() + loss.std() / len(loss) ** 0.5:
            break
        best, loss = model_, min(loss, after, key=np.mean)
    assert sum(r.kept for r in model.history) > 0
    for a, b in ((model.text.weight, best.text.weight), (model.metadata.weight, best.metadata.weight), (model.mix, best.mix), (model.text_line, best.text_line)):
        assert np.allclose(a, b, atol=1e-9)


def test_exchange_covers_all_sure_documents(spark, tables):
    docs, labels = tables
    model = co.fit(docs, labels, rounds=0)
    table = co.views(docs.limit(100)).selectExpr("*", "cast(null as double) as label")
    rows = table.toPandas()
    a, b = co._matrix(rows.text_view, np.uint8, co.GRAMS) / 255.0, co._matrix(rows.metadata_view, np.float32, co.META).astype(float)
    by_text, by_metadata = model.logits(a, b)
    edge = np.log(0.95 / 0.05)
    got = co._exchange(table, model, 0.95)
    for sums, view, x, judge in ((got[0], model.text, a, by_metadata), (got[1], model.metadata, b, by_text)):
        take = np.abs(judge) >= edge
        assert take.any() and np.allclose(sums, view.sums(x[take], (judge[take] > 0).astype(float)))


def test_degenerate_labels(spark, tables):
    docs, labels = tables
    assert co.fit(docs, labels.limit(0)).constant == 1.0
    assert co.fit(docs, labels.where("quality = 0")).constant == 0.0
    few = co.fit(docs, spark.createDataFrame([(0, 1), (1, 0), (1, None), (None, 1)], "doc_id long, quality int"))
    assert co.classify(docs, few).where("score is null or isnan(score)").count() == 0


def test_odd_texts_and_clashing_columns(odd, no_docs, tables):
    model = co.fit(*tables)
    got = co.classify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "kept"] + list(co.ADDED)
    assert got.count() == odd.count() and got.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert co.classify(no_docs, model).count() == 0
    assert co.fit(no_docs, tables[1]).constant == 1.0
    assert got.where("doc_id = 5").select("score").distinct().count() <= 2  # equal texts of different sources
