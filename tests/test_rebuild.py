"""Rebuilding with several documents."""

from readlake.operators import rebuild


def test_shared_strings_belong_to_their_document(spark):
    cells = spark.createDataFrame([(1, 0, "s", None), (2, 0, "s", None), (2, 1, "s", None), (3, 0, "n", "7")], "doc long, idx int, type string, value string")
    strings = spark.createDataFrame([(1, 0, "apple"), (2, 0, "bee"), (1, 1, "other")], "doc long, idx int, text string")
    got = rebuild.xlsx_cells(cells, strings, {"s": "shared", "n": "plain"}).select("doc", "idx", "shown").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "apple"), (2, 0, "bee"), (3, 0, "7")]


def test_bodies_stay_out_of_the_running_sums(spark, monkeypatch):
    """Parts are placed by lengths alone: no running sum sorts and writes the texts."""
    widest, sums = [], rebuild.running_sums

    def watched(rows, *more, **measures):
        widest.append(max(len(str(tuple(r))) for r in rows.collect()))
        return sums(rows, *more, **measures)

    monkeypatch.setattr(rebuild, "running_sums", watched)
    bodies = {1: "a" * 5000, 2: " ", 3: "<h1>own</h1>" + "b" * 3000, 4: "é🙂" * 2000}
    df = spark.createDataFrame([("x", k, None if k == 4 else "t", b) for k, b in bodies.items()], "owner string, pos int, title string, body string")
    rows = rebuild.assemble_in_parts(df, "owner", "pos", "title", "body", 700).orderBy("part").collect()
    whole = "<h2>t</h2>" + bodies[1] + "<hr>" + bodies[3] + "<hr><h2>Chapter 3</h2>" + bodies[4]
    assert [r["body"] for r in rows] == [whole[k : k + 700] for k in range(0, len(whole), 700)]
    assert max(widest) < 200
