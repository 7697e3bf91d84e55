import pytest

from dupscan import params as P


def _build(**kw):
    base = dict(recursive=True, in_folder=False, limit_extensions=True, px_size=50, show_progress=False, processes=1, extra={})
    directory = kw.pop("directory", None)
    return P.BuildParams.of(directory, **(base | kw))


def _search(**kw):
    base = dict(similarity=0, rotate=True, same_dim=True, show_progress=False, processes=1, chunksize=None, extra={})
    return P.SearchParams.of(**(base | kw))


def test_directories(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.write_text("x")
    assert P.check_directories((str(b), str(a))) == [str(a), str(b)]
    assert P.check_directories(([str(b)], [str(a)])) == [str(a), str(b)]
    for wrong in ((), ([],), (str(a), [str(b)]), (str(a), str(a)), (3,)):
        with pytest.raises(ValueError):
            P.check_directories(wrong)
    with pytest.raises(FileNotFoundError):
        P.check_directories((str(tmp_path / "none"),))


@pytest.mark.parametrize("given,out", [("duplicates", 0), ("similar", 5), (0, 0), (2.5, 2.5), ("3", 3)])
def test_similarity(given, out):
    assert P.check_similarity(given) == out


@pytest.mark.parametrize("given", ["low", "normal", "high", -1, "x", None])
def test_wrong_similarity(given):
    with pytest.raises(P.ParameterError):
        P.check_similarity(given)


def test_nan_passes():
    assert P.check_similarity("nan") != P.check_similarity("nan")


@pytest.mark.parametrize("name,good,bad", [("px_size", [10, 50, 5000], [9, 5001, 50.0]), ("processes", [1, True], [0, 10**6, "4"]), ("recursive", [True, False], [0, "yes"]), ("in_folder", [True], [1]), ("limit_extensions", [False], ["no"]), ("show_progress", [True], [None])])
def test_build(tmp_path, name, good, bad):
    for x in good:
        assert getattr(_build(directory=(str(tmp_path),), **{name: x}), name) == x
    for x in bad:
        with pytest.raises(P.ParameterError):
            _build(directory=(str(tmp_path),), **{name: x})


@pytest.mark.parametrize("name,good,bad", [("chunksize", [None, 1, 100], [0, 1.5]), ("rotate", [True], [1]), ("same_dim", [False], ["y"]), ("processes", [1], [0])])
def test_search(name, good, bad):
    for x in good:
        assert getattr(_search(**{name: x}), name) == x
    for x in bad:
        with pytest.raises(P.ParameterError):
            _search(**{name: x})


def test_keywords():
    assert _search(extra={"unknown": 1}).similarity == 0
    with pytest.raises(P.ParameterError):
        _search(extra={"lazy": True})


def test_destination(tmp_path):
    assert P.check_destination(str(tmp_path / "x" / "y")).is_dir()
    (tmp_path / "f").write_text("")
    for wrong in (3, str(tmp_path / "f")):
        with pytest.raises(P.ParameterError):
            P.check_destination(wrong)
