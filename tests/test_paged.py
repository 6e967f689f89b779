"""The paged source against a plain loop, and its broken, empty and endless pages."""

import json

import pytest

from tunelode.sources import paged

NAMES = [x.split()[0] for x in paged.SCHEMA.split(", ")]


def item(i, **more):
    t = {"id": f"t{i}", "name": f"Track {i}", "artists": [{"name": "A"}, {"name": "B"}], "album": {"name": "L", "images": [{"url": "u1"}, {"url": "u2"}]}, "duration_ms": 1000 + i, "external_ids": {"isrc": f"IS{i}"}, **more}
    return {"track": t, "item": {"id": "wrong"}} if i % 2 else {"track": None, "item": t}


class Pages:
    def __init__(self, root):
        self.root, self.index = root, []

    def listing(self, name, pages, kind="playlist", **more):
        """Pages by their items, or by their raw text; a page names the next one, in its own folder."""
        folder = self.root / name
        folder.mkdir()
        for k, page in enumerate(pages):
            text = page if isinstance(page, str) else json.dumps({"items": page, "next": f"p{k + 1}.json" if k + 1 < len(pages) else None, "total": 99})
            (folder / f"p{k}.json").write_text(text)
        self.index.append({"url": f"{name}/p0.json", "kind": kind, "source": name, "user_id": len(self.index), **more})
        (self.root / "index").write_text("\n".join(map(json.dumps, self.index)) + "\n\n")

    def plain(self, name, kind, cap):
        """What a loop over the pages gives."""
        out, n, at = [], 0, f"{self.root}/{name}/p0.json"
        while at and n < cap:
            data = json.loads(open(at).read())
            for x in data["items"] or []:
                if n < cap:
                    t = x if kind in ("top", "playlists") else (x or {}).get("track") or (x or {}).get("item")
                    if t and t.get("id") and not (kind == "playlist" and t.get("is_local")):
                        out.append((name, n, t["id"], t["name"]))
                n += 1
            at = data["next"] and f"{self.root}/{name}/{data['next']}"
        return out


def load(spark, root, **options):
    spark.dataSource.register(paged.PagedLibrary)
    df = spark.read.format("paged_library").options(path=f"file://{root}", **options).load()
    assert df.columns == NAMES
    return df


def found(df):
    return sorted((r.source, r.place, r.item_id, r.title) for r in df.collect())


def test_listings_equal_a_plain_loop(spark, tmp_path):
    p = Pages(tmp_path)
    p.listing("one", [[item(i) for i in range(50)], [item(50, is_local=True), item(51, id=None), item(52, id=""), None, {"track": None, "item": None}], [], None, [item(53)]])
    p.listing("liked", [[item(1, is_local=True), item(2)]], kind="liked")
    p.listing("top", [[item(i)["item"] for i in range(0, 8, 2)]], kind="top")
    p.listing("capped", [[item(i) for i in range(3)] for _ in range(4)], max_items=7)
    p.listing("lists", [[{"id": f"l{k}-{i}", "name": "L", "tracks": {"total": i or ""}} for i in range(50)] for k in range(6)], kind="playlists")
    p.listing("none", [[]])
    want = sorted(sum((p.plain(x["source"], x["kind"], x.get("max_items") or paged.CAPS.get(x["kind"], 10**9)) for x in p.index), []))
    for options in ({}, {"listings": 4}, {"listings": 100}):
        df = load(spark, tmp_path, **options)
        assert found(df) == want and df.rdd.getNumPartitions() == -(-6 // int(options.get("listings", 1)))
    assert sum(s == "lists" for s, *_ in want) == 200 and sum(s == "capped" for s, *_ in want) == 7
    assert found(load(spark, tmp_path, max_items=5)) == sorted(sum((p.plain(x["source"], x["kind"], 5) for x in p.index), []))
    one = load(spark, tmp_path).where("source = 'one' AND place = 3").first()
    assert (one.title, one.artist, one.album, one.duration_ms, one.isrc, one.artwork_url, one.preview_url, one.page, one.user_id, one.error) == ("Track 3", "A", "L", 1003, "IS3", "u1", None, 0, 0, None)
    totals = {r.item_id: r.total for r in load(spark, tmp_path).where("kind = 'playlists'").collect()}
    assert totals["l0-0"] is None and totals["l1-7"] == 7
    listings = spark.createDataFrame([(f"file://{tmp_path}/{x['url']}", x["kind"], x["source"], x["user_id"], x.get("max_items")) for x in p.index], paged.LISTING)
    assert found(paged.follow(listings.repartition(3), batch=20)) == want


@pytest.mark.parametrize("page", ["{broken", "[1, 2]", "", '{"items": [], "next": "gone.json"}', '{"items": [{"track": {"id": "x", "name": "X"}}], "next": "p0.json"}'])
def test_broken_pages_end_their_listing(spark, tmp_path, page):
    p = Pages(tmp_path)
    p.listing("good", [[item(1)], [item(2)]])
    p.listing("bad", [[item(i) for i in range(4)], page])
    with pytest.raises(Exception, match="BrokenPage"):
        load(spark, tmp_path).collect()
    got = load(spark, tmp_path, mode="permissive").collect()
    assert sorted(r.item_id for r in got if r.source == "good") == ["t1", "t2"]
    bad = [r for r in got if r.source == "bad"]
    assert [r.item_id for r in bad if r.error is None][:4] == ["t0", "t1", "t2", "t3"]
    assert [r.error for r in bad if r.error] and sum(r.error is not None for r in bad) == 1
    assert found(load(spark, tmp_path, max_items=4)) == [("bad", i, f"t{i}", f"Track {i}") for i in range(4)] + [("good", 0, "t1", "Track 1"), ("good", 1, "t2", "Track 2")]


def test_pages_in_a_bundle(spark, tmp_path):
    lines = [{"key": f"a:{k}", "items": [item(2 * k), item(2 * k + 1)], "next": f"#a:{k + 1}" if k < 2 else None} for k in range(3)] + [{"key": "b:0", "items": [item(9)], "next": "#b:1"}]
    folder = tmp_path / "some"
    folder.mkdir()
    for k in range(2):
        (folder / f"part-{k}").write_text("".join(json.dumps(x) + "\n" for x in lines[2 * k : 2 * k + 2]))
    (folder / "_SUCCESS").write_text("")
    (tmp_path / "index").write_text("\n".join(json.dumps({"url": f"some#{n}:0", "kind": "playlist", "source": n}) for n in "ab"))
    got = load(spark, tmp_path, mode="PERMISSIVE", listings=9).collect()
    assert sorted((r.source, r.place, r.item_id) for r in got if not r.error) == [("a", k, f"t{k}") for k in range(6)] + [("b", 0, "t9")]
    assert [(r.source, "b:1" in r.error) for r in got if r.error] == [("b", True)]


def test_no_listings(spark, tmp_path):
    (tmp_path / "index").write_text("")
    assert load(spark, tmp_path).count() == 0
    assert paged.follow(spark.createDataFrame([], paged.LISTING)).count() == 0


def test_addresses():
    assert paged.resolved("/a/b/p0.json", "p1.json") == "/a/b/p1.json"
    assert paged.resolved("file:///a/b/p0", "../c/p1") == "file:///a/c/p1"
    assert paged.resolved("hdfs://n:1/a/b/p0", "p1") == "hdfs://n:1/a/b/p1"
    assert paged.resolved("hdfs://n:1/a/b/p0", "s3://x/y") == "s3://x/y"
    assert paged.resolved("file:///a/b#x:0", "#x:1") == "file:///a/b#x:1" and paged.resolved("/a/b#x", "c#y") == "/a/c#y"
