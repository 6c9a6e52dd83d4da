import hashlib
import random
import zlib

from voxelfield.llm import merkle_log as ml
from tests.llm.conftest import MESSY, frame


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def expected(rows):
    """Sorted result rows of a plain loop over (doc_id, text, lang, source)."""
    trees = {}
    for doc_id, text, lang, source in rows:
        n_chars = None if text is None else len(text)
        own = leaf_of(doc_id, source, lang, n_chars, text)
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        cut = leaf_of(doc_id, source, lang, n_chars, None if text is None else text.replace("\n", "")) if even else own
        trees.setdefault((source is not None, (source or "").encode()), []).append((doc_id is not None, doc_id or 0, own, cut))
    names = sorted(trees)
    levels = {t: levels_of([r[2] for r in sorted(trees[t])]) for t in names}
    top = levels_of([levels[t][-1][0] for t in names])
    out = []
    for at, tree in enumerate(names):
        for i, (known, doc_id, own, cut) in enumerate(sorted(trees[tree])):
            node, siblings = cut, []
            for stack, index in ((levels[tree], i), (top, at)):
                for level in stack[:-1]:
                    first = index - index % 3
                    near = level[first : first + 3]
                    siblings += near[: index - first] + near[index - first + 1 :]
                    near[index - first] = node
                    node, index = sha(*near), index // 3
            out.append((doc_id if known else None, own, levels[tree][-1][0], top[-1][0], sha(*siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(df):
    return sorted((tuple(r) for r in ml.manifest(df).select(*COLUMNS).collect()), key=str)


def test_positions_follow_from_sizes():
    for n in [*range(1, 90), 243, 244, 729, 800]:
        top = ml.height(n)
        order = []
        for i in range(n):
            order.append((0, i))
            for level in range(1, top + 1):
                if i < n - 1 and (i + 1) % 3**level:
                    break
                order.append((level, i // 3**level))
        assert [ml.position(level, j, n) for level, j in order] == list(range(len(order)))
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        log = ml.postorder(leaves, top)
        levels = levels_of([d.hex() for d in leaves])
        assert [d.hex() for d in log] == [levels[level][j] for level, j in order]


def test_proofs_of_a_log():
    for n in (1, 2, 3, 4, 10, 81, 100):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        log = ml.postorder(leaves, ml.height(n))
        for i in range(n):
            proof = ml.siblings_of(log, i, n, ml.height(n))
            assert ml.fold(leaves[i], i, n, proof) == (log[-1], len(proof))
            if n > 1:
                assert ml.fold(b"x" * 32, i, n, proof)[0] != log[-1]


def test_messy_rows_against_a_loop(spark, messy, empty):
    assert found(messy) == expected(MESSY)
    assert ml.manifest(empty).collect() == []


def test_hot_source_over_several_rounds(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, "a\nb" * (i % 4), None, "hot" if rng.random() < 0.7 else f"s{rng.randint(0, 400)}") for i in range(1500)]
    rows += [(7, "same", "en", "hot")] * 300
    assert found(frame(spark, rows).repartition(5)) == expected(rows)


def test_log_table(spark):
    rows = spark.createDataFrame([("t", i, 300, bytearray(hashlib.sha256(str(i).encode()).digest())) for i in range(300)], "tree string, index long, n long, leaf binary")
    forest = ml.Forest(rows, "test")
    log = sorted(forest.log().collect(), key=lambda r: r.position)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(300)]
    assert [r.position for r in log] == list(range(len(log)))
    assert [bytes(r.digest) for r in log] == ml.postorder(leaves, ml.height(300))
    assert forest.roots().head().root == log[-1].digest
