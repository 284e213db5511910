"""Small literal arrays and their results under each operator."""

import math

import pytest

from latticework.frame import ArrayFrame
from latticework.lang import afl
from latticework.schema import ArrayError
from latticework.sources.literal import build, literal


@pytest.fixture(scope="module")
def A(spark):
    return {
        "m3": build(spark, "<amt:double>[ii=0:2,3,0, jj=0:2,3,0]", "ii*3+jj"),
        "m4": build(spark, "<amt:double>[ii=0:3,4,0, jj=0:3,4,0]", "ii*4+jj"),
        "m6": build(spark, "<amt:double>[ii=0:5,6,0, jj=0:5,6,0]", "ii*6+jj"),
        "r34": build(spark, "<amt:double>[rr=0:2,3,0, cc=0:3,4,0]", "rr*4+cc+1"),
        "B": literal(spark, "<amt1:double, amt2:double null>[ii=0:3,4,0, jj=0:2,3,0]", "[[(1.5,null),(),(-6,-5)],[(),(),(4,1)],[(4.5,null),(12,9),(3,null)],[(),(2,6.5),(6,null)]]"),
        "rk": literal(spark, "<amt:int64>[ii=0:3,4,0, jj=0:3,4,0]", "[[8,2,1,6],[2,4,7,7],[3,4,8,9],[5,8,5,8]]"),
        "q": literal(spark, "<amt:int64>[ii=0:10,11,0]", "[(12),(2),(1),(2),(6),(5),(8),(13),(7),(2),(2)]"),
        "nulls": literal(spark, "<amt1:double null, amt2:double null>[ii=0:3,4,0, jj=0:3,4,0]", "[[(3,null),(null,2.75),(),()],[(),(8,null),(nan,null),(null,3.5)],[(7.5,9),(null,null),(),(inf,7.25)],[(-inf,4),(null,inf),(),(1.5,2.625)]]"),
        "left": literal(spark, "<amt:double>[ii=0:2,3,0, jj=0:5,6,0]", "[[2.1,2.2,2.3,2.4,2.5,2.6],[],[]]"),
        "right": literal(spark, "<amt:double>[ii=0:2,3,0, jj=0:2,6,0]", "[[3,(),()],[(),4,()],[(),(),5]]"),
        "v": build(spark, "<amt:double>[ii=0:9,10,0]", "ii"),
    }


def grid(a: ArrayFrame, attr: int = 0) -> dict:
    n = len(a.schema.dims)
    return {tuple(r[:n]): r[n + attr] for r in a.df.collect()}


def rows(a: ArrayFrame) -> list[tuple]:
    return sorted((tuple(r) for r in a.df.collect()), key=lambda r: r[: len(a.schema.dims)])


def matrix(a: ArrayFrame, attr: int = 0) -> list[list]:
    g = grid(a, attr)
    return [[v for (ii, _), v in sorted(g.items()) if ii == k] for k in sorted({ii for ii, _ in g})]


CASES = {
    "regrid(m4, 2, 2, avg(amt) as Average)": [[2.5, 4.5], [10.5, 12.5]],
    "window(m4, 0, 2, 0, 2, max(amt))": [[10, 11, 11, 11], [14, 15, 15, 15], [14, 15, 15, 15], [14, 15, 15, 15]],
    "window(m4, 0, 2, 0, 2, min(amt))": [list(range(k, k + 4)) for k in (0, 4, 8, 12)],
    "variable_window(m4, ii, 1, 1, sum(amt))": [[4, 6, 8, 10], [12, 15, 18, 21], [24, 27, 30, 33], [20, 22, 24, 26]],
    "variable_window(m4, jj, 1, 1, sum(amt))": [[1, 3, 6, 5], [9, 15, 18, 13], [17, 27, 30, 21], [25, 39, 42, 29]],
    "thin(m6, 0, 1, 0, 2)": [[0, 2, 4], [6, 8, 10], [12, 14, 16], [18, 20, 22], [24, 26, 28], [30, 32, 34]],
    "thin(m6, 1, 2, 1, 2)": [[7, 9, 11], [19, 21, 23], [31, 33, 35]],
    "cumulate(r34, sum(amt), rr)": [[1, 2, 3, 4], [6, 8, 10, 12], [15, 18, 21, 24]],
    "cumulate(r34, prod(amt), rr)": [[1, 2, 3, 4], [5, 12, 21, 32], [45, 120, 231, 384]],
    "cumulate(r34, avg(amt), cc)": [[1, 1.5, 2, 2.5], [5, 5.5, 6, 6.5], [9, 9.5, 10, 10.5]],
    "xgrid(m3, 2, 2)": [[0, 0, 1, 1, 2, 2]] * 2 + [[3, 3, 4, 4, 5, 5]] * 2 + [[6, 6, 7, 7, 8, 8]] * 2,
    "merge(left, right)": [[2.1, 2.2, 2.3, 2.4, 2.5, 2.6], [4], [5]],
    "transpose(m3)": [[0, 3, 6], [1, 4, 7], [2, 5, 8]],
    "reverse(m3)": [[8, 7, 6], [5, 4, 3], [2, 1, 0]],
    "subarray(m4, 1, 1, 2, 2)": [[5, 6], [9, 10]],
    "between(m4, 1, null, 1, 2)": [[4, 5, 6]],
    "spgemm(m3, m3)": [[15, 18, 21], [42, 54, 66], [69, 90, 111]],
    "substitute(nulls, build(<s:double>[ii=0:0,1,0], 0), amt2)": None,
    "adddim(slice(m3, ii, 1), z)": [[3, 4, 5]],
}


@pytest.mark.parametrize("text", [k for k, v in CASES.items() if v])
def test_matrices(A, text):
    assert matrix(afl.run(text, A)) == CASES[text]


def test_sparse_cumulate(A):
    got = rows(afl.run("cumulate(B, avg(amt1), avg(amt2), jj)", A))
    want = {(0, 0): (1.5, None), (0, 2): (-2.25, -5), (1, 2): (4, 1), (2, 0): (4.5, None), (2, 1): (8.25, 9), (2, 2): (6.5, 9), (3, 1): (2, 6.5), (3, 2): (4, 6.5)}
    assert {r[:2]: r[2:] for r in got} == {k: tuple(None if x is None else pytest.approx(x) for x in v) for k, v in want.items()}
    var = grid(afl.run("cumulate(B, var(amt1))", A))
    assert var[(1, 2)] == pytest.approx(50) and var[(0, 0)] is None and var[(3, 1)] == pytest.approx(50)


def test_quantile_and_ranks(A):
    assert [r[1:] for r in rows(afl.run("quantile(q, 2)", A))] == [(0, 1), (0.5, 5), (1, 13)]
    ranks = {r[:2]: r[3] for r in rows(afl.run("rank(rk, amt)", A))}
    assert ranks[(0, 2)] == 1 and ranks[(0, 1)] == ranks[(1, 0)] == 2 and ranks[(0, 0)] == 12
    by = {r[:2]: r[3] for r in rows(afl.run("avg_rank(rk, amt, ii)", A))}
    assert by[(1, 2)] == by[(1, 3)] == 3.5 and by[(3, 0)] == by[(3, 2)] == 1.5


def test_rank_leaves_null_and_nan(A):
    got = {r[:2]: r[3] for r in rows(afl.run("rank(nulls, amt1)", A))}
    assert got[(0, 1)] is None and math.isnan(got[(1, 2)]) and got[(3, 0)] == 1 and got[(2, 3)] == 6


def test_substitute(A):
    got = afl.run("substitute(nulls, build(<s:double>[ii=0:0,1,0], 0), amt1)", A)
    assert grid(got)[(0, 1)] == 0 and grid(got, 1)[(0, 0)] is None and not got.schema.attr("amt1").nullable


def test_aggregate_rules(A, spark):
    empty = afl.run("aggregate(filter(m3, amt > 100), sum(amt) as s, prod(amt) as p, count(*) as n, avg(amt) as a, min(amt) as m)", A)
    assert rows(empty) == [(0, 0.0, 1.0, 0, None, None)]
    nan = literal(spark, "<v:double>[x=0:2,3,0]", "[nan,1,2]").aggregate("min(v)", "max(v)")
    assert all(math.isnan(x) for x in rows(nan)[0][1:])
    assert nan.schema.attr_names == ["v_min", "v_max"]
    assert rows(afl.run("count(m3)", A)) == [(0, 9)] and rows(afl.run("sum(m3, amt, ii)", A)) == [(0, 3), (1, 12), (2, 21)]
    one = rows(afl.run("aggregate(slice(m3, ii, 0), stdev(amt), jj)", A))
    assert [r[1] for r in one] == [None, None, None]


def test_join_names_and_cross_join(A):
    jj = afl.run("join(m3, m3)", A)
    assert jj.schema.attr_names == ["amt", "amt_2"] and len(rows(jj)) == 9
    c = afl.run("cross_join(m3, v, jj, ii)", A)
    assert c.schema.dim_names == ["ii", "jj"] and grid(c, 1)[(2, 1)] == 1
    assert afl.run("cross_join(m3, v)", A).schema.dim_names == ["ii", "jj", "ii_2"]


def test_unpack_numbers_by_chunk(spark):
    a = build(spark, "<v:int64>[ii=0:3,2,0, jj=0:3,2,0]", "ii*4+jj").unpack("x")
    assert [r[3] for r in rows(a)] == [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]


def test_sort_puts_null_then_nan_first(A):
    up = [r[1] for r in rows(afl.run("sort(nulls, amt1 asc)", A))]
    assert up[:4] == [None] * 4 and math.isnan(up[4]) and up[5:7] == [-math.inf, 1.5] and up[-1] == math.inf
    down = [r[1] for r in rows(afl.run("sort(nulls, amt1 desc)", A))]
    assert down[0] == math.inf and down[-4:] == [None] * 4


def test_uniq_and_index_lookup(A):
    u = afl.run("uniq(sort(project(q, amt)))", A)
    assert [r[1] for r in rows(u)] == [1, 2, 5, 6, 7, 8, 12, 13]
    got = {r[0]: r[2] for r in rows(afl.run("index_lookup(q, uniq(sort(project(q, amt))), amt)", A))}
    assert got[0] == 6 and got[2] == 0


def test_redimension(spark):
    flat = literal(spark, "<rr:int64 null, cc:int64, v:string null>[k=0:3,4,0]", "[(1,1,'a'),(1,1,'b'),(2,3,'c'),(null,1,'d')]")
    one = flat.redimension("<v:string null>[rr=1:3,3,0, cc=1:3,3,0]")
    assert rows(one) == [(1, 1, "a"), (2, 3, "c")]
    many = flat.redimension("<v:string null>[rr=1:3,3,0, cc=1:3,3,0, s=0:9,10,0]")
    assert rows(many) == [(1, 1, 0, "a"), (1, 1, 1, "b"), (2, 3, 0, "c")]
    count = flat.redimension("<n:uint64>[rr=1:3,3,0]", "count(*) as n")
    assert rows(count) == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="lies outside"):
        flat.redimension("<v:string null>[rr=1:1,3,0, cc=1:3,3,0]").df.collect()


def test_redimension_overflow(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(8)], "i long, g long")
    a = ArrayFrame.from_table(df, ["i"])
    fits = a.redimension("<i:int64>[g=0:9,10,0, s=2:5,4,0]").df.collect()
    assert len(fits) == 8 and {r["s"] for r in fits} == {2, 3, 4, 5}
    with pytest.raises(Exception, match="redimension: s = 5 lies outside"):
        a.redimension("<i:int64>[g=0:9,10,0, s=2:4,3,0]").df.collect()


def test_lookup_unfold_concat_reshape(A, spark):
    p = literal(spark, "<x:int64, y:int64>[k=0:1,2,0]", "[(0,1),(2,2)]")
    assert rows(p.lookup(A["m3"])) == [(0, 1.0), (1, 8.0)]
    u = afl.run("unfold(apply(v, w, amt + 1))", A)
    assert u.schema.dim_names == ["ii", "unfold_1"] and u.schema.attr_names == ["amt"] and grid(u)[(3, 1)] == 4
    c = afl.run("concat(m3, m3)", A)
    assert c.schema.dims[0].hi == 5 and grid(c)[(3, 0)] == 0
    r = afl.run("reshape(m3, <amt:double>[k=0:8,9,0])", A)
    assert [x[1] for x in rows(r)] == list(range(9))


def test_cross_between(A, spark):
    ranges = literal(spark, "<a:int64, b:int64, c:int64, d:int64>[k=0:2,3,0]", "[(0,0,1,1),(1,1,3,3),(2,0,1,3)]")
    got = set(grid(A["m4"].cross_between(ranges)))
    want = {(ii, jj) for ii in range(4) for jj in range(4) if (ii <= 1 and jj <= 1) or (ii >= 1 and jj >= 1)}
    assert got == want


def test_windows_against_brute_force(spark):
    cells = {(ii, jj): float((ii * 7 + jj * 3) % 10) for ii in range(9) for jj in range(9) if (ii * jj) % 3 != 1}
    a = literal(spark, "<v:double>[ii=0:8,9,0, jj=0:8,9,0]", "".join(f"{{{ii},{jj}}}({v})" for (ii, jj), v in cells.items()))
    got = {tuple(r[:2]): (r[2], r[3]) for r in a.window(1, 2, 0, 1, "sum(v)", "count(*)").df.collect()}
    for (ii, jj) in cells:
        box = [v for (x, y), v in cells.items() if ii - 1 <= x <= ii + 2 and jj <= y <= jj + 1]
        assert got[(ii, jj)] == (pytest.approx(sum(box)), len(box))


def test_linear_algebra(A, spark):
    import numpy as np

    m = build(spark, "<v:double>[ii=0:3,4,0, jj=0:2,3,0]", "ii*ii + jj*2 + ii*jj")
    x = np.array([[ii * ii + jj * 2 + ii * jj for jj in range(3)] for ii in range(4)], float)
    s = [r[1] for r in rows(m.gesvd("S"))]
    assert np.allclose(s, np.linalg.svd(x)[1], atol=1e-6)
    u, v = np.zeros((4, 3)), np.zeros((3, 3))
    for ii, k, y in rows(m.gesvd("U")):
        u[ii, k] = y
    for k, jj, y in rows(m.gesvd("VT")):
        v[k, jj] = y
    assert np.allclose(u @ np.diag(s) @ v, x, atol=1e-6)
    g = afl.run("gemm(m3, m3, m3, 'TRANSB=1;ALPHA=2;BETA=-1')", A)
    y = np.arange(9.0).reshape(3, 3)
    assert np.allclose(matrix(g), 2 * y @ y.T - y)


def test_components_of_images(spark):
    img = literal(spark, "<p:int64>[z=0:1,2,0, y=0:3,4,0, x=0:3,4,0]", "{0,0,0}(9){0,1,1}(9){0,3,3}(9){0,0,3}(1){1,0,0}(9)")
    got = {r[:3]: r[3] for r in rows(img.findstars("p", 5))}
    assert got[(0, 0, 0)] == got[(0, 1, 1)] != got[(0, 3, 3)] and len(got) == 4 and got[(1, 0, 0)] not in (got[(0, 0, 0)], got[(0, 3, 3)])
    obs = literal(spark, "<center_y:double, center_x:double>[k=0:3,4,0]", "[(5,4),(6,5),(7,6),(14,14)]")
    g = {r[0]: r[3] for r in rows(obs.groupstars(1.5))}
    assert g[0] == g[1] == g[2] != g[3]


ERRORS = [
    "window(m4, -1, 0, 0, 0, sum(amt))", "window(m4, 0, 0, 0, 0, sum(amt))", "regrid(m4, 0, 1, sum(amt))", "thin(m6, 0, 0, 0, 1)", "thin(m6, 0, 4, 0, 1)", "thin(m6, 3, 2, 0, 1)",
    "cross_join(m3, v, ii)", "join(m3, v)", "slice(m3, ii, 0, ii, 1)", "reshape(m3, <amt:double>[k=0:9,10,0])", "cast(m3, <a:double>[ii=0:2,3,0])", "deldim(m3)", "deldim(v)", "normalize(m3)",
    "quantile(q, 0)", "apply(m3, amt, 1)", "apply(m3, w, nothing + 1)", "project(m3, w)", "xgrid(m3, 0, 1)", "lookup(v, m3)", "cross_between(m4, v)", "aggregate(m3, sum(amt), amt)",
    "concat(m3, v)", "unfold(apply(v, w, 'x'))", "uniq(m3)", "merge(m3, v)", "redimension(v, <x:double>[ii=0:9,10,0])", "nonsense(m3)", "build(<a:double>[ii=0:*,1,0], ii)", "filter(m3, amt + 1)",
]


@pytest.mark.parametrize("text", ERRORS)
def test_preconditions(A, text):
    with pytest.raises(ArrayError):
        afl.run(text, A)


IDENTITIES = [("transpose(transpose(m4))", "m4"), ("reverse(reverse(m4))", "m4"), ("merge(m4, m4)", "m4"), ("deldim(adddim(m4, z))", "m4"), ("redimension(unpack(m4, x), <amt:double>[ii=0:3,4,0, jj=0:3,4,0])", "m4"), ("merge(between(m4, 0, 0, 1, 3), between(m4, 2, 0, 3, 3))", "m4"), ("repart(m4, <amt:double>[ii=0:3,2,0, jj=0:3,2,0])", "m4"), ("sg(m4, 1)", "m4"), ("thin(xgrid(m4, 2, 2), 0, 2, 0, 2)", "m4"), ("cast(m4, <amt:double>[ii=0:3,4,0, jj=0:3,4,0])", "m4")]


@pytest.mark.parametrize(("left", "right"), IDENTITIES)
def test_identities(A, left, right):
    assert rows(afl.run(left, A)) == rows(afl.run(right, A))


def test_singular_vectors_multiply_rows_and_not_cells(spark, monkeypatch):
    """Sparse and wide or long, in small strips: no join of cells, nor an aggregate of their products."""
    import numpy as np

    from latticework.operators import linalg

    monkeypatch.setattr(linalg, "STRIP", 12)
    for high, wide in ((40, 5), (5, 40)):
        m = build(spark, f"<v:double>[ii=0:{high - 1},7,0, jj=0:{wide - 1},7,0]", "ii*ii%7 + jj*ii%5 + jj").filter("(ii + 2*jj) % 3 <> 0")
        x = np.zeros((high, wide))
        for ii, jj, y in rows(m):
            x[ii, jj] = y
        u, s, v = np.zeros((high, 5)), np.zeros(5), np.zeros((5, wide))
        for f, out in zip(linalg.svd(m), (u, s, v)):
            for *at, y in rows(f):
                out[tuple(at)] = y
        assert np.allclose(s, np.linalg.svd(x)[1], atol=1e-6) and np.allclose(u * s @ v, x, atol=1e-6)
        plan = m.gesvd("VT" if wide > high else "U").df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
