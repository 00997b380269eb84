"""Stores: visibility, replacement, deletion, compaction, recovery, and a model under random commands."""

import json
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry import Representation, VectorStore, VectorStoreWriter
from heronry.sources import files
from heronry.sources.store import Manifest

R = Representation("enc", "1", 4, True)
LOOSE = Representation("enc", "1", 4, False)


def vectors(n, seed=0, unit=True):
    x = np.random.default_rng(seed).normal(size=(n, 4)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x


@pytest.fixture
def writer(spark, tmp_path):
    return VectorStoreWriter.create(tmp_path / "s", "docs", R, spark=spark)


def reader(writer):
    return VectorStore(writer._at, writer.spark)


def test_a_new_store_is_empty(writer):
    view = reader(writer).view()
    assert (view.document_ids, view.commit, "a" in view, view.document_lengths(["a"])) == ([], 0, False, {})
    assert view.fetch([])[0].shape == (0, 4)
    assert view.as_of.tzinfo is not None and view.as_of <= datetime.now(timezone.utc)


def test_nothing_is_seen_before_commit_and_views_do_not_change(writer):
    store = reader(writer)
    x = vectors(3)
    writer.append(["a", "b"], x, [1, 2])
    assert store.view().document_ids == []
    before = store.view()
    committed = writer.commit()
    now = store.view()
    assert before.document_ids == [] and now.document_ids == ["a", "b"] and store.view() is now
    assert now.as_of == committed and now.commit == 1
    assert now.document_lengths(["b", "nobody", "a"]) == {"b": 2, "a": 1}
    packed, lengths = now.fetch(["b", "a", "b"])
    assert lengths.tolist() == [2, 1, 2]
    assert np.array_equal(packed, x[[1, 2, 0, 1, 2]])
    with pytest.raises(ValueError, match="nobody"):
        now.fetch(["a", "nobody"])
    with pytest.raises(TypeError):
        now.document_lengths("ab")


def test_replacement_deletion_and_return(writer):
    store, x = reader(writer), vectors(6)
    writer.append(["a", "b"], x[:2], [1, 1])
    writer.commit()
    writer.append(["a"], x[2:4], [2])
    writer.commit()
    assert store.view().document_lengths(["a", "b"]) == {"a": 2, "b": 1}
    assert writer.delete(["a", "nobody", "a"]) == 1
    assert writer.delete(["a"]) == 0
    writer.commit()
    assert store.view().document_ids == ["b"]  # the older row of a doesn't return
    writer.append(["a"], x[4:5], [1])
    writer.commit()
    assert np.array_equal(store.view().fetch(["a"])[0], x[4:5])


def test_order_within_one_commit(writer):
    x = vectors(4)
    writer.append(["a", "b"], x[:2], [1, 1])
    assert writer.delete(["a"]) == 1
    writer.append(["b"], x[2:3], [1])
    writer.delete(["b"])
    writer.append(["b"], x[3:4], [1])
    writer.commit()
    view = reader(writer).view()
    assert view.document_ids == ["b"] and np.array_equal(view.fetch(["b"])[0], x[3:4])


def test_compaction_changes_nothing_but_files(writer):
    store, x = reader(writer), vectors(8)
    writer.append(["a", "b", "c"], x[:4], [1, 2, 1])
    writer.commit()
    writer.append(["b"], x[4:5], [1])
    writer.delete(["c"])
    writer.commit()
    before = store.view()
    ids, packed = before.document_ids, before.fetch(["a", "b"])[0]
    writer.compact()
    assert store.view() is before
    writer.commit()
    after = store.view()
    assert after.document_ids == ids and np.array_equal(after.fetch(["a", "b"])[0], packed)
    assert len(after.manifest.segments) == 1 and not after.manifest.tombstones
    assert np.array_equal(before.fetch(["b"])[0], packed[1:])  # an older view still reads its files
    assert writer.vacuum() == [] and len(writer.vacuum(0)) == 3
    writer.compact()
    assert writer.manifest.next_id == after.manifest.next_id  # nothing to do
    assert after.document_ids == ids


def test_compaction_of_nothing(writer):
    writer.append(["a"], vectors(1), [1])
    writer.delete(["a"])
    writer.commit()
    writer.compact()
    writer.commit()
    assert reader(writer).view().manifest.segments == () and reader(writer).view().document_ids == []


def test_an_empty_commit_renews_the_time(writer):
    first = writer.commit()
    assert writer.commit() >= first and reader(writer).view().commit == 2
    writer.append([], np.zeros((0, 4)), [])
    assert writer.manifest.segments == ()


@pytest.mark.parametrize(
    ("ids", "x", "lengths", "text"),
    [
        (["a", "a"], vectors(2), [1, 1], "more than once"), (["a"], vectors(2), [1], "sum"), (["a"], vectors(1), [0], "positive"), (["a", "b"], vectors(1), [1], "lengths"), (["a"], np.ones((1, 3)), [1], "dimension"),
        (["a"], np.full((1, 4), np.nan), [1], "finite"), (["a"], np.ones((1, 4)), [1], "unit"),
    ],
)
def test_bad_documents_are_refused(writer, ids, x, lengths, text):
    with pytest.raises(ValueError, match=text):
        writer.append(ids, x, lengths)
    writer.commit()
    assert reader(writer).view().document_ids == []


def test_frames_are_checked_alike(spark, writer):
    def rows(*r):
        return spark.createDataFrame(list(r), "doc_id string, token_count int, vectors array<float>")

    good = [1.0, 0.0, 0.0, 0.0]
    for r, text in ((("a", 2, good), "token_count"), ((None, 1, good), "id"), (("a", 1, [float("inf")] * 4), "finite"), (("a", 1, [1.0] * 4), "unit")):
        with pytest.raises(ValueError, match=text):
            writer.append_frame(rows(r))
    with pytest.raises(ValueError, match="more than once"):
        writer.append_frame(rows(("a", 1, good), ("a", 1, good)))
    writer.append_frame(rows())
    writer.append_frame(rows(("a", 1, good), ("b", 2, good * 2)))
    writer.commit()
    assert reader(writer).view().document_lengths(["a", "b"]) == {"a": 1, "b": 2}


@pytest.mark.parametrize("representation", [R, LOOSE])
def test_int8_stores_reconstruct(spark, tmp_path, representation):
    w = VectorStoreWriter.create(tmp_path / "i", "docs", representation, encoding="int8", spark=spark)
    x = vectors(50, unit=representation.normalized) * (1 if representation.normalized else 10)
    w.append([f"d{i}" for i in range(25)], x, [2] * 25)
    w.commit()
    store = reader(w)
    got, _ = store.view().fetch([f"d{i}" for i in range(25)])
    assert np.abs(got - x).max() < 1e-2 * max(1, np.abs(x).max())
    assert store.score_semantics == "int8-reconstructed-approximate-full-maxsim" and store.encoding == "int8"
    w.delete(["d0"])
    w.compact()
    w.commit()
    assert np.array_equal(store.view().fetch(["d1"])[0], got[2:4])


def test_creation_refuses(spark, tmp_path, writer):
    with pytest.raises(FileExistsError):
        VectorStoreWriter.create(writer._at, "docs", R, spark=spark)
    for change in ({"corpus": ""}, {"encoding": "int4"}):
        with pytest.raises(ValueError):
            VectorStoreWriter.create(**({"path": tmp_path / "n", "corpus": "c", "representation": R, "spark": spark} | change))
    with pytest.raises(FileNotFoundError):
        VectorStore(tmp_path / "nothing", spark)


def test_a_writer_removes_what_was_never_committed(spark, writer):
    writer.append(["a"], vectors(1), [1])
    writer.commit()
    writer.append(["b"], vectors(1), [1])
    writer.delete(["a"])
    second = VectorStoreWriter(writer._at, spark)
    assert [n for n in files.names(spark, writer._at) if "-" in n] == ["segment-0"]
    second.append(["c"], vectors(1), [1])
    second.commit()
    assert reader(second).view().document_ids == ["a", "c"]


def test_a_failed_publication_changes_nothing(writer, monkeypatch):
    writer.append(["a"], vectors(1), [1])

    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(files, "publish_text", fail)
    with pytest.raises(OSError):
        writer.commit()
    monkeypatch.undo()
    assert reader(writer).view().document_ids == []
    writer.commit()
    assert reader(writer).view().document_ids == ["a"]


def test_a_replaced_store_is_followed_only_if_it_is_alike(spark, writer, tmp_path):
    store = reader(writer)
    other = VectorStoreWriter.create(tmp_path / "o", "docs", R, spark=spark)
    other.append(["z"], vectors(1), [1])
    other.commit()
    alike = VectorStore(other._at, spark)
    store._at = other._at
    assert store.view().document_ids == ["z"]
    foreign = VectorStoreWriter.create(tmp_path / "f", "other", R, spark=spark)
    alike._at = foreign._at
    with pytest.raises(ValueError, match="replaced"):
        alike.view()


@pytest.mark.parametrize(
    "change",
    [
        {"format": "x"}, {"corpus": ""}, {"store_id": ""}, {"committed_at": -1}, {"encoding": "f64"}, {"next_id": 0}, {"segments": [{"id": 1, "documents": 1, "tokens": 1}, {"id": 0, "documents": 1, "tokens": 1}]}, {"tombstones": [5]},
        {"commit": -1}, {"commit": True}, {"commit": 2**63}, {"segments": [{"id": 0}]}, {"unknown": 1}, {"representation": {}},
    ],
)
def test_broken_manifests_are_refused(change):
    good = Manifest("s", "float32", "c", R, 1, 2, 1.5, ((0, 1, 1),), (1,))
    assert Manifest.from_json(good.to_json()) == good
    with pytest.raises(ValueError):
        Manifest.from_json(json.dumps(json.loads(good.to_json()) | change))


def test_numbers_run_out(spark, writer):
    from dataclasses import replace

    writer._staged = replace(writer.manifest, next_id=2**63 - 1)
    with pytest.raises(ValueError, match="no ids left"):
        writer.append(["a"], vectors(1), [1])
    writer.manifest = replace(writer.manifest, commit=2**63 - 1)
    with pytest.raises(ValueError, match="no commit"):
        writer.commit()


def test_random_commands_equal_a_dictionary(spark, writer):
    r, held, seen = random.Random(4), {}, {}
    store = reader(writer)
    for step in range(14):
        what = r.choice(["append", "append", "delete", "commit", "compact"])
        if what == "append":
            ids = r.sample("abcdefgh", r.randrange(1, 4))
            lengths = [r.randrange(1, 4) for _ in ids]
            writer.append(ids, vectors(sum(lengths), step), lengths)
            held |= dict(zip(ids, lengths, strict=True))
        elif what == "delete":
            ids = r.sample("abcdefgh", 3)
            assert writer.delete(ids) == len(held.keys() & set(ids))
            held = {k: v for k, v in held.items() if k not in ids}
        elif what == "compact":
            writer.compact()
        else:
            writer.commit()
            seen = dict(held)
        view = store.view()
        assert view.document_lengths(list("abcdefgh")) == {k: seen[k] for k in "abcdefgh" if k in seen}
    assert view.index().select(F.sum("token_count")).first()[0] == (sum(seen.values()) or None)
