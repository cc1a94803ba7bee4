"""Source divergence, conversation repair and byte-pair encoding against SQL, brute force and the library."""

import collections
import glob
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, conversations, divergence

SF = "/root/testdata/sf0.001"
FAR = 2**60


# Source divergence


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_divergence_equals_sql(spark, duck):
    got = divergence.op11_source_divergence(spark, SF)
    want = duck.sql(divergence.SQL_OP11)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def brute_audit(rows, least, top):
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), collections.Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = sorted(((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s), key=lambda x: (-x[1], x[0].encode()))
            terms = sorted(((t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out |= {(lang, s, part, i, v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (i, v) in enumerate(found, 1)}
    return out


def test_divergence_ties_nulls_and_unused_columns(spark):
    """Dozens of terms of one value, which long common beginnings and letters of several bytes tell apart."""
    many = [a + b for a, b in itertools.product(["same", "samesame", "samé", "日本", "z"], "abcdé語")]
    rows = [("en", "a", " ".join(many))] * 4 + [("en", "b", "other words only")] * 3 + [(None, None, None), ("", "x", "One one ONE"), ("de", "s", None), ("de", None, "nur hier"), ("en", "c", "\x00 1 2 -"), ("en", "b", " lead and tail ")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term long, value string")
    for least, top in ((1, 10), (1, 3), (4, 7), (9, 5)):
        got = divergence.audit(df, least_docs=least, top=top).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_audit(rows, least, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_stay_whole_beyond_long(spark):
    row = spark.range(1).select(divergence.share("9000000000000000L", "9100000000000001L", "7L")).first()[0]
    assert row == 1 + 10**9 * (9 * 10**15 + 2) // (91 * 10**14 + 1 + 14)


# Conversation repair


def brute_repair(rows):
    """Forward table of the least cheapest string of edits for each state."""
    word, to = re.compile(r"[^\x20\x09-\x0D]"), {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    seen, faults = set(), []
    for _, role, text in rows:
        w = word.findall(text)
        faults.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))

    def better(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    def inserted(table):
        for _ in range(3):
            for s, (cost, audit, left) in list(table.items()):
                better(table, to[s], (cost + 5, audit + "I", (*left, (name[to[s]], ""))))
        return table

    table = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for s, (cost, audit, left) in table.items():
            better(after, s, (cost + 2, audit + "D", left))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] and (role[0] == to[s] or (s, role[0]) == ("", "s")):
                better(after, role[0], (cost + more, audit + "K", (*left, (role, text))))
            better(after, to[s], (cost + more + 1, audit + "R", (*left, (name[to[s]], text))))
        table = inserted(after)
    cost, audit, left = min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])
    return gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def by_conversation(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
        hurt, ids = [], {r[0] for r in rows}
        for c, turn, role, text in rows:
            k = zlib.crc32(f"{c}:{turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            hurt += [(c, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        got = found(conversations.op12_conversation_repair(spark, sf))
        by = by_conversation(hurt)
        assert got == {c: brute_repair(by.get(c, [])) for c in ids}


def random_rows(n, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", "Why? ", "x.", None, "tail  "]
    return [(r.choice([1, 2, FAR + 1, FAR + 3, None]) if r.random() < 0.5 else 7, r.choice([None, *range(40), FAR + 1]), r.choice(["user", "assistant", "system", "tool", None, "", "umpire"]), r.choice(texts) if r.random() < 0.4 else f"line {r.randrange(300)}" + r.choice([".", ""])) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(4096, 1024, 8 << 20, 4 << 20, 16_384), (30, 4, 8 << 20, 4 << 20, 64), (5, 1, 50, 20, 8)])
def test_long_conversations_in_segments(spark, monkeypatch, sizes):
    """One conversation has half of all rows; ids beyond 2**53 stand beside nulls."""
    for name, n in zip(("LONG", "SEGMENT", "LONG_BYTES", "SEGMENT_BYTES", "TOGETHER"), sizes):
        monkeypatch.setattr(conversations, name, n)
    rows = random_rows(700, sizes[0])
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, part string, idx int, mark int").repartition(5)
    assert found(conversations.repair(df)) == {c: brute_repair(r) for c, r in by_conversation(rows).items()}


def test_repaired_text_and_empty_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Bye."), (2, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.repair(rows, copies=F.when(F.col("conv_id") == 2, 0).otherwise(1), with_repaired=True).collect()}
    assert (got[1]["audit"], got[1]["repaired"], got[1]["cost"]) == ("RK", "user:Hi.\nassistant:Bye.", 1)
    assert tuple(got[2])[1:9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(rows.limit(0)).count() == 0


# Byte-pair encoding

ODD = [
    None, "", " \n\t ", "a<|endoftext|>b <|ENDOFTEXT|> ≯<|startoftext|≯ x", "<|startoftext|><|endoftext|> ", "été İSTANBUL ΣΑΣ ﬁ ½ ² ٣ 日本語  a\u0085b\x1cc \x00 don't can't''s I'LL 'RE",
    "a" * 5000, "ab" * 3000 + "é" * 100, "https://x.y/z?a=1&b=22 <html>&amp; \U0001f600\U0001f600\U0001f1eb\U0001f1f7", "ŉ ǅ K Å ẞ", "é ́x",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeinthsor'.,!0 9éßü日\U0001f600-ǅΣ́<|>") for _ in range(r.randrange(60))) for _ in range(n)]


def test_query_equals_library(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    t, got = library(), bpe.op13_bpe_trie(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = t.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("nodes,deep,known", [(600_000, 48, 200_000), (50, 3, 10), (1, 0, 1)])
def test_trie_of_any_size_equals_library(monkeypatch, nodes, deep, known):
    monkeypatch.setattr(bpe, "NODES", nodes)
    monkeypatch.setattr(bpe, "DEEP", deep)
    monkeypatch.setattr(bpe, "KNOWN", known)
    c, t = bpe.Codec(bpe.default_tokenizer()), library()
    texts = ODD + random_texts(1500)
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        for got, want in zip(c.ids(part), t.encode_batch([x or "" for x in part], add_special_tokens=False)):
            assert got.tolist() == want.ids and c.text(got) == t.decode(want.ids, skip_special_tokens=False)


def test_shared_prefixes_are_encoded_once():
    c = bpe.Codec(bpe.default_tokenizer())
    last = chr(ord("a") + bpe.LAST)
    c.trie.encode(sorted("antidisestablishment" + x + last for x in "bcdefg"))
    assert len(c.trie.last) == 1 + 20 + 2 * 6  # root, the prefix, and a letter and an end for each word


def test_odd_rows_and_round_trip(spark):
    rows = [(FAR + 1, ODD[3], "x"), (FAR + 3, ODD[5], None), (None, "only", "y"), (FAR + 1, ODD[3], "x"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1)
    out = bpe.encode(df, with_decoded=True)
    got = bpe.decode(out, out="again").collect()
    t = library()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r[0]: r[1] for r in rows}
    for r in got:
        ids = t.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == r["again"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0)).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="word ends"):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
