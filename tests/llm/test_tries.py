import hashlib
import random
import zlib

import duckdb
import pytest

from tidemark.llm import queries, tries


def rebuilt(rows):
    """rows: (conv, turn, role, text); the turns of each rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            m = f"{len(role or '')}:{role or ''}{text or ''}"
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(m.encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = [*own.get(c - rest, [])[:h], *mine[h:]]
    return out


def brute(rows):
    paths = rebuilt(rows)
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    size = lambda n: len(n[-1][1].encode()) if n else 0
    out = []
    for n, m in members.items():
        inside = [k for k in members if k[: len(n)] == n]
        childless = [k for k in inside if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in inside)]
        ends = sorted(c for c in m if len(paths[c]) == len(n))
        out.append((
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), sum(len(k) == len(n) + 1 for k in inside), len(childless),
            sum((len(members[k]) - 1) * size(k) for k in inside), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        c = c - 11 if rng.random() < 0.9 else c + 1000
        rows += [(c, rng.choice([k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long text"])) for k in range(rng.randrange(1, 14))]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], COLUMNS + ", conv int, depth string")
    return sorted((tuple(r) for r in tries.trie(tries.branched(tries.numbered(df))).collect()), key=str)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_equal_to_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(tries, "CHUNK", chunk)
    rng = random.Random(7)
    rows = conversations(rng, 60)
    rows += [(None, 1, "user", "nobody"), (2**63 - 1, 0, "user", "a"), (-(2**63), 0, "user", "a")]
    rows += [(500 + k, t, "user", "the same first turns") for k in range(40) for t in range(3 + k % 2)]  # copies
    rows += [(700, t, "user", str(t % 7)) for t in range(50)] + [(700, 3, "user", "3")]  # a long one, a repeated row
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 >= 1 and c % 5)
    assert got(spark, [(alone, 0, "user", "x")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_query_and_its_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op11_conversation_trie(spark, sf)
    found = sorted((tuple(r) for r in df.collect()), key=str)
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    sql = con.execute(queries.TRIE_SQL)
    assert [d[0] for d in sql.description] == df.columns
    assert sorted(sql.fetchall(), key=str) == found
