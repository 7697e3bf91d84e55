import json
import os
import struct
import zlib

import numpy as np
import pytest

from dupscan import actions, api, cli
from dupscan.sources import decode, listing

PX = 10


def png(image, colour=2, depth=8, filters=0, palette=None):
    """A PNG file's bytes; image: height x width x channels samples."""
    h, w = image.shape[:2]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = image.reshape(h, -1)
    if depth == 16:
        rows = np.stack([rows, rows], 2).reshape(h, -1)
    elif depth < 8:
        bits = ((rows[..., None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(h, -1)
        rows = np.packbits(bits.astype(np.uint8), axis=1)
    step = max(1, image.shape[2] * depth // 8)
    raw, before = b"", np.zeros(rows.shape[1], np.int64)
    for row in rows.astype(np.int64):
        left = np.r_[np.zeros(step, np.int64), row[:-step]]
        corner = np.r_[np.zeros(step, np.int64), before[:-step]]
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, before, corner])
        guess = [0, left, before, (left + before) // 2, paeth][filters]
        raw += bytes([filters]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))]
    if palette is not None:
        parts.append(chunk(b"PLTE", palette.tobytes()))
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


RNG = np.random.default_rng(7)
A = RNG.integers(0, 256, (PX, PX, 3)).astype(np.uint8)


@pytest.mark.parametrize("filters", range(5))
def test_png_filters(filters):
    image = RNG.integers(0, 256, (13, 9, 3)).astype(np.uint8)
    assert (decode.decode_image(png(image, filters=filters)) == image).all()


def test_png_kinds():
    rgba = RNG.integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (decode.decode_image(png(rgba, 6)) == rgba[..., :3]).all()
    grey = RNG.integers(0, 256, (5, 7, 1)).astype(np.uint8)
    assert (decode.decode_image(png(grey, 0)) == grey).all()
    assert (decode.decode_image(png(grey, 0, 16)) == grey).all()
    small = RNG.integers(0, 4, (5, 7, 1)).astype(np.uint8)
    assert (decode.decode_image(png(small, 0, 2)) == small * 85).all()
    palette = RNG.integers(0, 256, (4, 3)).astype(np.uint8)
    assert (decode.decode_image(png(small, 3, 2, palette=palette)) == palette[small[..., 0]]).all()


def test_pnm_and_bmp():
    image = RNG.integers(0, 256, (4, 6, 3)).astype(np.uint8)
    assert (decode.decode_image(b"P6 # c\n6 4\n255\n" + image.tobytes()) == image).all()
    assert (decode.decode_image(b"P3\n6 4\n255\n" + b" ".join(str(x).encode() for x in image.ravel())) == image).all()
    assert (decode.decode_image(b"P5\n6 4\n255\n" + image[..., 0].tobytes()) == image[..., :1]).all()
    assert decode.decode_image(b"P1\n3 1\n1 0 1\n")[0, :, 0].tolist() == [0, 255, 0]
    rows = b"".join(r[:, ::-1].tobytes().ljust(20, b"\0") for r in image[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 4, 1, 24, 0, len(rows), 0, 0, 0, 0)
    assert (decode.decode_image(head + rows) == image).all()


@pytest.mark.parametrize("data", [b"", b"junk", b"\x89PNG\r\n\x1a\n", png(A)[:-40], b"P6\n9 9\n255\nxx", b"BM" + b"\0" * 60])
def test_broken_files(data):
    with pytest.raises(Exception):  # noqa: B017
        decode.decode_image(data)


@pytest.fixture
def tree(tmp_path):
    for d in ("x/sub", "x/.hid", "x/[b]", "y"):
        (tmp_path / d).mkdir(parents=True)
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("x/a.png", png(A))
    put("x/sub/b.PNG", png(np.ascontiguousarray(np.rot90(A, 2))))
    put("x/bad.png", b"junk")
    put("x/t.txt", b"text")
    put("x/_u.png", png(A + np.uint8(16)))
    put("x/.h.png", png(A))
    put("x/.hid/x.png", png(A))
    put("x/[b]/z.png", png(A + np.uint8(1)))
    put("y/copy.png", png(A))
    put("y/other.ppm", b"P6\n10 10\n255\n" + (255 - A).tobytes())
    return tmp_path


def _build(spark, *roots, **kw):
    return api.build(spark, *map(str, roots), px_size=PX, show_progress=False, processes=1, **kw)


def test_listing_and_build(spark, tree):
    repo = _build(spark, tree / "y", tree / "x")
    rows = {os.path.relpath(r.path, tree): r for r in repo.images.collect()}
    assert sorted(rows, key=lambda k: rows[k].file_id) == ["x/[b]/z.png", "x/_u.png", "x/a.png", "x/bad.png", "x/sub/b.PNG", "y/copy.png", "y/other.ppm"]
    assert [rows[k].file_id for k in ("x/[b]/z.png", "x/bad.png", "x/sub/b.PNG")] == [0, 3, 4]
    assert bytes(rows["x/a.png"].tensor) == A.tobytes() and rows["x/a.png"].px_sum == A.sum(dtype=int)
    assert rows["x/bad.png"].tensor is None and rows["x/bad.png"].decode_error
    s = repo.stats
    assert s["total_files"] == 8 and s["invalid_files"]["count"] == 2
    assert s["invalid_files"]["logs"][str(tree / "x/t.txt")] == listing.UNSUPPORTED
    flat = _build(spark, tree / "x", recursive=False)
    assert sorted(os.path.basename(r.path) for r in flat.images.collect()) == ["_u.png", "a.png", "bad.png"]
    assert {os.path.basename(r.path) for r in _build(spark, tree / "x", recursive=False, limit_extensions=False).images.collect()} == {"_u.png", "a.png", "bad.png", "t.txt"}


def test_search_and_reuse(spark, tree):
    repo = _build(spark, tree)
    name = lambda *p: str(tree.joinpath(*p))
    found = api.search(repo, show_progress=False, processes=1)
    assert found.result == {name("x/_u.png"): [[name("x/a.png"), 0.0], [name("x/sub/b.PNG"), 0.0], [name("y/copy.png"), 0.0]]}
    assert found.lower_quality == [name("x/_u.png"), name("x/a.png"), name("x/sub/b.PNG")]
    similar = api.search(repo, "similar", show_progress=False, processes=1)
    assert similar.stats["process"]["search"]["matches_found"] == {"duplicates": 0, "similar": 1} or similar.stats["process"]["search"]["matches_found"]["similar"] >= 1
    assert "search" not in repo.stats["process"] and found.stats["process"]["search"]["matches_found"] == {"duplicates": 3, "similar": 0}
    repo.save(f"file://{tree}/saved")
    again = api.search(api.ImageRepo.load(spark, f"file://{tree}/saved"), show_progress=False, processes=1)
    assert again.result == found.result


def test_in_folder(spark, tree):
    repo = _build(spark, tree / "x", tree / "y", tree / "x/t.txt", in_folder=True)
    assert {r.group_id for r in repo.images.collect()} == {0, 1}
    found = api.search(repo, show_progress=False, processes=1)
    (folder, groups), *rest = found.result.items()
    assert not rest and folder == str(tree / "x/[b]") and [len(v) for v in groups.values()] == [2]


def test_overlapping_roots_list_a_file_once(spark, tree):
    repo = _build(spark, tree, tree / "y")
    assert repo.images.count() == repo.images.select("path").distinct().count() == 7


def test_move_and_delete(spark, tree, monkeypatch):
    found = api.search(_build(spark, tree), show_progress=False, processes=1)
    plan = actions.move_plan(found.lower_quality_files, str(tree / "out")).collect()
    assert len(plan) == 3 and not any(r.collision for r in plan) and (tree / "x/a.png").exists()
    moved = found.move_to(str(tree / "out"))
    assert sorted(os.listdir(tree / "out")) == ["_u.png", "a.png", "b.PNG"] and found.lower_quality == moved
    rest = api.search(_build(spark, tree / "out"), show_progress=False, processes=1)
    assert actions.delete_files(rest.lower_quality_files, ask=lambda _: "n") == 0
    assert rest.delete(silent_del=True) == 2 and os.listdir(tree / "out") == ["b.PNG"]
    none = api.search(_build(spark, tree / "out"), show_progress=False, processes=1)
    assert none.delete() == 0 and none.result == {}
    with pytest.raises(ValueError):
        none.delete(silent_del="yes")


def test_command_line(spark, tree):
    files = cli.main(["-D", str(tree / "x"), str(tree / "y"), "-Z", str(tree / "res"), "-px", str(PX), "-p", "no", "-proc", "1", "-s", "0"], spark)
    result, worse, stats = (open(f).read() for f in files)
    assert len(json.loads(result)) == 1 and len(worse.split()) == 3 and json.loads(stats)["process"]["search"]["files_searched"] == 6
    for wrong in (["-mv", "m", "-d", "yes"], ["-la", "yes"]):
        with pytest.raises(ValueError):
            cli.main(["-D", str(tree), *wrong], spark)
    with pytest.raises(SystemExit):
        cli.main(["-r", "perhaps"], spark)


def test_jvm_decoder(spark, tree):
    """A format that is left to the JVM: a GIF of one colour."""
    gif = b"GIF89a\x02\x00\x02\x00\x80\x00\x00\x0a\x14\x1e\xff\xff\xff,\x00\x00\x00\x00\x02\x00\x02\x00\x00\x02\x02\x84Q\x00;"
    (tree / "y/g+ %20.gif").write_bytes(gif)
    (tree / "x/[b]/h.GIF").write_bytes(gif)
    for root, name in (("y", "g+ %20.gif"), ("x/[b]", "h.GIF")):
        row = {os.path.basename(r.path): r for r in _build(spark, tree / root, recursive=False).images.collect()}[name]
        assert (row.width, row.height, bytes(row.tensor)) == (2, 2, bytes([10, 20, 30]) * PX * PX)


def test_without_logs_and_with_all_files(spark, tree):
    with pytest.warns(UserWarning, match="limit_extensions"):
        _build(spark, tree / "y", limit_extensions=False)
    bare = _build(spark, tree, logs=False).stats
    assert bare["invalid_files"] == {"count": 2, "logs": {}} and bare["total_files"] == 8


def test_written_results_are_the_dictionaries(spark, tree):
    import io

    from dupscan.operators import grouping

    for in_folder in (False, True):
        found = api.search(_build(spark, tree / "x", tree / "y", in_folder=in_folder), "similar", show_progress=False, processes=1)
        for groups in (found.groups, found.groups.where("false")):
            out = io.StringIO()
            grouping.write_json(groups, in_folder, out)
            want = grouping.result_infolder(groups) if in_folder else grouping.result_union(groups)
            assert json.loads(out.getvalue()) == want


def test_effective_chunksize():
    from dupscan.operators.stats import effective_chunksize

    assert [effective_chunksize(*x) for x in ((None, 10), (7, 10), (None, 10_000), (None, 3_000_000), (7, 10_000))] == [None, 7, 100, 1, 7]
