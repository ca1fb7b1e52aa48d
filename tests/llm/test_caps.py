import numpy as np
import pytest

from spoor.llm import caps
from spoor.llm.caps import Code, link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, kind string"


def spread(rng, centre, cosine, n):
    """Unit vectors at a cosine of about ``cosine`` to a centre."""
    noise = rng.normal(size=(n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * noise


def sample(dim=64, singles=900, seed=5):
    """Random vectors, pairs just above the limit, a group of near ones, copies."""
    rng = np.random.default_rng(seed)

    def unit(n):
        x = rng.normal(size=(n, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    base = unit(singles)
    pairs = np.concatenate([spread(rng, b, rng.uniform(0.931, 0.95), 1) for b in base[:250]])
    below = np.concatenate([spread(rng, b, 0.92, 1) for b in base[250:300]])
    group = spread(rng, unit(1)[0], 0.975, 150)
    copies = np.repeat(unit(1), 40, axis=0) * rng.uniform(0.5, 3, size=(40, 1)).round(0)
    x = np.concatenate([base, pairs, below, group, copies]).astype(np.float32)
    labels = rng.integers(0, 2, len(x))
    labels[singles : singles + 300] = labels[:300]
    labels[-190:] = 1
    return [(i, v.tolist(), int(a), 7, "x") for i, (v, a) in enumerate(zip(x, labels))]


ODD = [
    (9000, None, 1, 0, ""), (9001, [0.0] * 64, 1, 0, ""), (9002, [float("nan")] + [1.0] * 63, 1, 0, ""),
    (9003, [float("inf")] + [1.0] * 63, 1, 0, ""), (9004, [None] + [1.0] * 63, 1, 0, ""),
    (9005, [1.0] * 64, None, 0, ""), (9006, [1.0] * 64, None, 0, ""), (9007, [], 1, 0, ""),
    (9008, [1.0, 2.0], 1, 0, ""), (9009, [2.0, 4.0], 1, 0, ""), (9009, [2.0, 4.0], 1, 0, ""),
    (None, [1.0, 2.0], 1, 0, ""), (None, [7.0], 3, 0, ""), (None, [7.0], 3, 0, ""),
    (9012, [1e30] * 3, 1, 0, ""), (9013, [2e30] * 3, 1, 0, ""), (9014, [-3.0], 3, 0, ""),
]


def exact(rows):
    """Links and components by comparing all pairs: (key, links, component) and the pairs."""
    pairs = set()
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    groups = {}
    for i, (_, v, label, *_) in enumerate(rows):
        good = v and label is not None and None not in v and np.isfinite(v).all() and any(v)
        if good:
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(np.triu(x @ x.T >= caps.COSINE, 1)):
            pairs.add((members[a], members[b]))
    for a, b in pairs:
        parent[find(a)] = find(b)
    least, links = {}, np.zeros(len(rows), int)
    for a, b in pairs:
        links[[a, b]] += 1
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return [(row[0], int(links[i]), least.get(find(i))) for i, row in enumerate(rows)], pairs


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = link_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = out.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    return sorted(((r[0], r[1], r[2]) for r in found), key=str)


def test_links_and_recall(spark):
    rows = sample()
    wanted, pairs = exact(rows)
    found = run(spark, rows)
    want = {k: (n, c) for k, n, c in wanted}
    assert len(found) == len(rows)
    assert all(n <= want[k][0] for k, n, _ in found), "no link below the limit"
    recall = sum(n for _, n, _ in found) / (2 * len(pairs))
    assert recall >= 0.97
    # The pairs at the limit alone, without the groups that weigh most.
    single = [(k, n) for k, n, _ in found if k < 250]
    assert sum(n for _, n in single) >= 0.95 * sum(want[k][0] for k, _ in single)
    # Copies, here scaled, are never lost.
    first = len(rows) - 40
    assert all(x == (k, 39, first) for k, x in ((x[0], x) for x in found if x[0] >= first))


def test_all_filters_give_all_links(spark):
    """With a code so small that everything meets, results are exact, however they are cut."""
    rows = sample(singles=300) + ODD
    wanted = sorted(exact(rows)[0], key=str)
    for part in (caps.PART, 40):
        assert run(spark, rows, hits=64, least=4, bucket=100_000, part=part) == wanted


def test_odd_rows(spark):
    assert run(spark, ODD) == sorted(exact(ODD)[0], key=str)
    assert run(spark, []) == []


@pytest.mark.parametrize("dim,size", [(1, 2), (2, 3), (7, 9), (64, 24)])
def test_decoding_lists_exactly_the_directions_beyond_the_bound(dim, size):
    code = Code(dim, size)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ code.turn
    left, right = y[:, : code.half] @ code.halves[0].T, y[:, code.half :] @ code.halves[1].T
    sums = (left[:, :, None] + right[:, None, :]).reshape(len(x), -1)
    row, found = code.decode(x)
    for r in range(len(x)):
        bound = min(code.bound * 2**0.5, np.sort(sums[r])[-code.least])
        assert found[row == r].tolist() == np.flatnonzero(sums[r] >= bound - 1e-9).tolist()
