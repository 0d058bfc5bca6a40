"""Lines of growing files by byte offset: what a stream has read equals a full read, and bytes are read once."""

import io
import json
import os
import random

import pytest

from tallyloom.sources import ranges
from tallyloom.streaming import source


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_lines_of_ranges_cover_a_file_once(monkeypatch, piece):
    monkeypatch.setattr(ranges, "PIECE", piece)
    rng = random.Random(piece)
    data = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) + b"\n" for _ in range(60)) + b"tail"
    whole, at = [], 0
    for line in data.split(b"\n"):
        if line or at < len(data):
            whole.append((at, line))
        at += len(line) + 1
    for split in (1, 2, 5, 16, 50, 10_000):
        found = []
        for low in range(0, len(data), split):
            found += ranges.lines_between(io.BytesIO(data), low, min(low + split, len(data)), low > 0)
        assert found == whole, split
    for end in range(len(data) + 1):
        assert ranges.last_newline(io.BytesIO(data), 0, end, 4) == data.rfind(b"\n", 0, end) + 1
        assert ranges.next_newline(io.BytesIO(data), end, len(data), 4) == (data.find(b"\n", end) + 1 or end)


def test_a_range_that_ends_at_a_newline_reads_its_own_bytes_only():
    data = b"one\ntwo\nthree\nfour\n"
    file = Counted(data)
    assert [x for _, x in ranges.lines_between(file, 4, 14)] == [b"two", b"three"]
    assert file.taken == 10


class Poller:
    """Triggers of the source without a query: what each of them reads."""

    def __init__(self, root, state, **options):
        self.options = {"path": str(root), "state": str(state), **options}
        self.reader, self.at = source.TailReader(self.options), {}
        self.rows, self.bytes = [], 0

    def restart(self):
        self.reader = source.TailReader(self.options)

    def poll(self):
        end = self.reader.latestOffset()
        new = []
        for part in self.reader.partitions(self.at, end):
            self.bytes += sum(high - low for _, _, low, high, _ in part.parts)
            for batch in self.reader.read(part):
                new += [tuple(r.values()) for r in batch.to_pylist()]
        self.at = end
        self.rows += new
        return new

    def told(self):
        """Lines of each file's last generation."""
        last = {}
        for name, generation, *_ in self.rows:
            last[name] = max(generation, last.get(name, 0))
        out = {}
        for name, generation, pos, line in sorted(self.rows, key=lambda r: (r[0], r[1], r[2])):
            if generation == last[name] and line is not None:
                out.setdefault(os.path.basename(name), []).append(line)
        return out


def full(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            whole = open(os.path.join(folder, n), "rb").read()
            lines = [x.decode() for x in whole[: whole.rfind(b"\n") + 1].split(b"\n") if x.strip()]
            if lines:
                out[n] = lines
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_sequence_of_changes_equals_a_full_read(tmp_path, seed):
    rng = random.Random(seed)
    root = tmp_path / "logs"
    (root / "sub").mkdir(parents=True)
    paths = [root / "a.jsonl", root / "sub" / "b.jsonl", root / "c.jsonl"]
    p = Poller(root, tmp_path / "state", splitbytes=str(rng.choice([7, 64, 1 << 20])))
    line = lambda: json.dumps({"n": rng.randint(0, 99), "pad": "x" * rng.randint(0, 40)}) + "\n"
    for step in range(40):
        path, kind = rng.choice(paths), rng.random()
        if kind < 0.55 or not path.exists():
            with open(path, "a") as f:
                f.write("".join(line() for _ in range(rng.randint(1, 5))))
        elif kind < 0.65:
            with open(path, "a") as f:
                f.write(line()[: rng.randint(1, 6)])  # half a line; the next one ends it
        elif kind < 0.75:
            os.truncate(path, rng.randint(0, path.stat().st_size))
        elif kind < 0.85:
            other = path.with_suffix(".new")
            other.write_text("".join(line() for _ in range(rng.randint(0, 30))))
            os.replace(other, path)
        elif kind < 0.92:
            path.unlink()
        elif path.stat().st_size:
            data = bytearray(path.read_bytes())
            data[:1] = b"["  # in place, as large as before
            path.write_bytes(data + line().encode())
        if rng.random() < 0.6:
            p.poll()
        if rng.random() < 0.2:
            p.restart()
    p.poll()
    complete = full(root)
    assert p.told() == complete


def test_appended_bytes_are_read_once(tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    p, written = Poller(root, tmp_path / "state"), 0
    for i in range(20):
        for name in ("a", "b"):
            with open(root / f"{name}.jsonl", "a") as f:
                written += f.write(json.dumps({"i": i, "name": name}) + "\n")
        p.poll()
        assert p.bytes == written
    assert not p.poll() and p.bytes == written


def test_an_unfinished_line_waits_and_settles_if_it_is_json(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2')
    p = Poller(tmp_path, tmp_path / "state")
    assert [r[3] for r in p.poll()] == ['{"a": 1}'] and not p.poll() and not p.poll()
    with open(tmp_path / "a.jsonl", "a") as f:
        f.write("}")
    assert not p.poll()
    assert [r[3] for r in p.poll()] == ['{"a": 2}'] and not p.poll()
    with open(tmp_path / "a.jsonl", "a") as f:
        f.write('\n{"a": 3}\n')
    assert [r[3] for r in p.poll()] == ['{"a": 3}']
    assert {r[1] for r in p.rows} == {0}


def test_a_trigger_is_bounded_and_long_lines_pass(tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"i": i}) + "\n" for i in range(100)) + json.dumps("y" * 5000) + "\n")
    (tmp_path / "b.jsonl").write_text('{"b": 1}\n')
    p, turns = Poller(tmp_path, tmp_path / "state", maxbytes="200"), 0
    while p.poll():
        turns += 1
    assert turns > 4 and len(p.told()["a.jsonl"]) == 101 and p.told()["b.jsonl"] == ['{"b": 1}']


def test_shards_part_the_files(tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.jsonl").write_text(f'{{"i": {i}}}\n')
    told = []
    for shard in range(3):
        p = Poller(tmp_path, tmp_path / f"state{shard}", shards="3", shard=str(shard))
        p.poll()
        told += p.told()
    assert len(told) == 30 == len(set(told))


def test_query_with_restarts(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    line = lambda i: json.dumps({"i": i}) + "\n"

    def run():
        stream = source.grown_lines(spark, str(root), str(tmp_path / "state"))
        put = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(100)

    (root / "a.jsonl").write_text("".join(map(line, range(10))))
    run()
    with open(root / "a.jsonl", "a") as f:
        f.write("".join(map(line, range(10, 15))) + '{"i"')
    run()
    (root / "a.jsonl").write_text("".join(map(line, range(3))))
    (root / "b.jsonl").write_text(line(7))
    run()
    rows = spark.read.schema(source.SCHEMA + ", batch int").parquet(str(tmp_path / "out")).collect()
    by = lambda g, name: sorted((r.pos, r.line) for r in rows if r.generation == g and r.file.endswith(name))
    assert [x for _, x in by(0, "a.jsonl")] == [json.dumps({"i": i}) for i in range(15)]
    assert [x for _, x in by(1, "a.jsonl")] == [None] + [json.dumps({"i": i}) for i in range(3)]
    assert len(by(0, "b.jsonl")) == 1 and len(rows) == 20
