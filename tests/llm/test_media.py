"""Matroska: files come back byte by byte, all lacings and block forms parse, faults are named."""

import random
import struct

import pytest

from maskbench.llm import media as m


@pytest.mark.parametrize("n", [192, 960, 1152, 7680, 7872, 61440 * 2 + 192])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    p = m.demux(m.mux(payload))
    b = m.mux(payload)
    assert p.error is None and b"".join(b[x[5]:x[5] + x[6]] for x in p.packets) == payload
    assert [x[4] for x in p.packets] == [i * m.FRAME * 1_000_000_000 // m.RATE for i in range(len(p.packets))]
    assert len(p.cues) == p.clusters and all(x[7] for x in p.packets)
    segment = b.index(m.SEGMENT.to_bytes(4, "big"))
    _, content = m.read_vint(b, segment + 4, len(b))
    for _, _, at in p.cues:
        assert b[content + at:content + at + 4] == m.CLUSTER.to_bytes(4, "big")


def file_of(cluster_body, known=True, scale=1_000_000):
    info = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, scale))
    cluster = m.element(m.CLUSTER, cluster_body) if known else m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster_body
    return m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + info + cluster + m.element(m.CUES, b"")


@pytest.mark.parametrize("lacing", [m.XIPH, m.EBML_LACING, None])
@pytest.mark.parametrize("known", [True, False])
def test_lacing(lacing, known):
    rng = random.Random(1)
    for _ in range(60):
        frames = [rng.randbytes(rng.choice([0, 1, 5, 254, 255, 256, 510, 9000])) for _ in range(rng.randint(2 if lacing else 1, 9))]
        block = m.block_of(frames, 300, -7, key=False, lacing=lacing)
        b = file_of(m.number(m.CLUSTER_TIMESTAMP, 50) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, block), known)
        p = m.demux(b)
        assert p.error is None and [b[x[5]:x[5] + x[6]] for x in p.packets] == frames
        assert {x[0] for x in p.packets} == {300} and p.packets[0][4] == 43_000_000 and not p.packets[0][7]


def test_block_groups_and_unknown_sizes():
    block = m.block_of([b"abc", b"abd"], 1, 10, key=False, lacing=m.FIXED)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block) + m.number(m.BLOCK_DURATION, 8))
    later = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block) + m.number(m.REFERENCE_BLOCK, 1))
    body = m.number(m.CLUSTER_TIMESTAMP, 5) + group + later
    second = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.CLUSTER_TIMESTAMP, 90) + group
    p = m.demux(file_of(body + second, known=False, scale=2_000_000))
    assert p.error is None and p.clusters == 2
    assert [(x[1], x[2], x[3], x[4] // 1_000_000, x[7]) for x in p.packets] == [
        (0, 0, 0, 30, True), (0, 0, 1, 38, True), (0, 1, 0, 30, False), (0, 1, 1, 30, False), (1, 0, 0, 200, True), (1, 0, 1, 208, True)]


def test_faults():
    whole = m.mux(bytes(range(192)) * 40)
    for cut in (0, 3, 60, len(whole) // 2, len(whole) - 1):
        p = m.demux(whole[:cut])
        assert cut == 0 or p.error
    assert m.demux(struct.pack(">Q", 0)).error


def test_rows(spark):
    rows = [(1, "short"), (2, ""), (3, None), (None, "é" * 50_000), (1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as packets")
    stored = m.store(docs)
    got = m.columns(stored.selectExpr("*", "5 as payload", "6 as `a.b`")).collect()
    for (d, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], None if r["n_bytes"] == 0 and r["doc_id"] == 3 else bytes(r["payload"]).decode().rstrip(" "))))):
        assert bytes(r["payload"]) == m.padded(t or "") and r["error"] is None and r["n_bytes"] == len((t or "").encode())
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id long, media binary")
    assert [r["error"] is not None and r["packets"] == [] for r in m.columns(bad).collect()] == [True, True]
    table = m.packet_table(stored.where("doc_id is null"))
    assert table.columns == ["doc_id", "n_bytes", "error", "track", "cluster", "block", "frame", "timestamp_ns", "offset", "size", "keyframe", "lacing"]
    assert table.count() == -(-len(m.padded("é" * 50_000)) // m.FRAME)
    assert m.columns(m.store(docs.where("false"))).count() == 0
