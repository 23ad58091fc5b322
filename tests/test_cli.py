import random
import struct

import numpy as np
import pytest

from lodevec import cli


@pytest.fixture
def files(tmp_path):
    rng = random.Random(3)
    words = ["deep", "graph", "vector", "search", "red", "blue"]
    texts = [" ".join(rng.choices(words, k=4)) for _ in range(120)]
    x = np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in texts], "<f4")
    (tmp_path / "v.fvecs").write_bytes(b"".join(struct.pack("<i", 8) + v.tobytes() for v in x))
    (tmp_path / "s.txt").write_text("\n".join(texts) + "\n")
    asks = [("deep.*search", 0), ("graph|red", 5), ("nosuch", 1), ("^blue", 9)]
    (tmp_path / "q.txt").write_text("".join(f"{p} {' '.join(f'{v:.6f}' for v in x[i])}\n" for p, i in asks))
    return tmp_path


def test_search_and_recall(spark, files, capsys):
    def search(algorithm, *options):
        out = files / algorithm
        assert cli.main(["search", algorithm, "5", str(files / "q.txt"), str(files / "v.fvecs"), "fvecs", str(files / "s.txt"), str(out), *options]) == 0
        return next((out / "text").glob("part-*")).read_text().split("\n")[:-1]

    truth = search("groundtruth")
    assert len(truth) == 4 and truth[2] == "" and all(len(t.split()) == 5 for t in (truth[0], truth[1], truth[3]))
    gt = str(files / "groundtruth" / "text")
    assert search("ann", "clusters=4", "pq_m=3", "pq_ksub=8", "max_iter=3", "ef=120", f"gt={gt}") == truth
    assert "Mean Recall@5: 1.0000" in capsys.readouterr().out
    assert search("hier", "clusters=4", "nprobe=2", "max_iter=3") == truth
    assert search("graph") == truth
    with pytest.warns(UserWarning):
        assert search("postfilter", "ef=3") == truth
    capsys.readouterr()
    assert cli.main(["recall", "--gt", gt, "--pred", str(files / "graph" / "text"), "--K", "5", "--verbose"]) == 0
    out = capsys.readouterr().out
    assert "query 2: 1.0000" in out and "Perfect: 4/4" in out


def test_bad_command_lines(spark, files):
    with pytest.raises(SystemExit):
        cli.main(["search", "nosuch", "5", "a", "b", "fvecs", "c", "d"])
    (files / "short").write_text("1 2\n")
    (files / "long").write_text("1 2\n3\n")
    with pytest.raises(SystemExit):
        cli.main(["recall", "--gt", str(files / "long"), "--pred", str(files / "short")])
