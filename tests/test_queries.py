"""Every registered query of the library against its SQL on the small tables."""

import collections
import math
import re

import duckdb
import pytest

from quillstone.operators import coverage, grounding, languages
from quillstone.plans import registry, usage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, order):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    wanted = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    names = sorted(found.columns)
    assert plain(found.collect(), [found.columns.index(c) for c in names]) == plain(wanted.fetchall(), [wanted.columns.index(c) for c in names])


def rows_of(duck, sql):
    return duck.sql(sql).fetchall()


def texts(duck):
    return dict(rows_of(duck, "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"))


def items(duck):
    return dict(rows_of(duck, "SELECT item_id, text FROM benchmark"))


def spans(duck):
    out = {}
    for i, t in texts(duck).items():
        source = None
        for j, q in items(duck).items():
            if max(grounding.parts(q), key=len, default="!")[:8] in t.lower() or q in t:  # a cheap look before the full one
                source = source or grounding.Source(t)
                if found := grounding.find_spans(source, q):
                    out[i, j] = found
    return out


def brute_document_sentences(duck, found):
    """Every letter is in one sentence, sentences are in order, trimmed and numbered; no end mark before a capital is inside."""
    of = {}
    for i, pos, a, b in sorted(found):
        of.setdefault(i, []).append((pos, a, b))
    for i, t in texts(duck).items():
        got = of.get(i, [])
        assert [p for p, _, _ in got] == list(range(len(got)))
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:], strict=False))
        inside = set().union(*(range(a, b) for _, a, b in got))
        assert all(k in inside for k, c in enumerate(t) if c.isalpha()), i
        assert all(t[a:b] == t[a:b].strip() for _, a, b in got)
        assert not any(re.search(r"[a-z]{3,}[!?] [A-Z]", t[a:b]) for _, a, b in got)
    return found


def brute_grounded_spans(duck, found):
    return [(i, j, s[0][0], s[-1][1]) for (i, j), s in spans(duck).items()]


def brute_verified_items(duck, found):
    out = []
    for (i, j), s in spans(duck).items():
        t = texts(duck)[i]
        around = [(a, b) for a, b in coverage.sentences_of(t) if s[0][0] < b and s[-1][1] > a]
        a, b = around[0][0], around[-1][1]
        out.append((i, j, a, b, "skips_across" if len(s) > 1 and len(around) > 1 else "sentence_too_long" if b - a > 800 else "grounded"))
    return out


def brute_planted_fakes(duck, found):
    planted, caught = collections.Counter(), collections.Counter()
    for i, j in spans(duck):
        q = items(duck)[j]
        fakes = {"changed number": re.sub(r"(\d+)", r"\g<1>0", q), "swapped word": re.sub(r"^(\S+) (\S+) ", r"\2 \1 ", q, count=1), "added negation": "never " + q}
        for kind, fake in fakes.items():
            if fake != q:
                planted[kind] += 1
                caught[kind] += grounding.find_span(grounding.Source(texts(duck)[i]), fake) is None
    return [(k, n, caught[k]) for k, n in planted.items()]


def brute_instruction_coverage(duck, found):
    quoted = collections.defaultdict(list)
    for (i, _), s in spans(duck).items():
        quoted[i] += s
    out = {}
    for i, n, _ in found:  # which sentences are instructions is an expression with tests of its own
        t = texts(duck)[i]
        covered = set()
        for a, b in coverage.sentences_of(t):
            ranges = quoted[i]
            hit = any(x < b and y > a for x, y in ranges)
            if hit and all(any(x <= m.start() and y >= m.end() for x, y in ranges) for m in coverage.CRITICAL.finditer(t, a, b)):
                covered.add(grounding.mapped(t[a:b])[0].strip())
        out[i] = (i, n, sum(grounding.mapped(t[a:b])[0].strip() in covered for a, b in coverage.sentences_of(t)))
    for i, n, n_covered in found:
        assert n_covered <= min(n, out[i][2])
    return found


def brute_shielded_turns(duck, found):
    of = {(c, t): x for c, t, x in rows_of(duck, "SELECT conv_id, turn, text FROM conversations")}
    for c, t, redacted, n in found:
        assert len(re.findall("⟦[A-Z]+_[A-Z]+⟧", redacted)) == n >= 1 and f"A{c + 100000}" not in redacted
        gaps = re.split("⟦[A-Z]+_[A-Z]+⟧", redacted)
        assert all(g in f"{of[c, t]} MRN: A{c + 100000}" for g in gaps)
    assert len(found) == len(of)
    return found


def brute_suppressed_funnel(duck, found):
    """The law of what is shown: true numbers only, no small one, and none that two shown numbers give away."""
    true = collections.defaultdict(lambda: [0] * 4)
    for name, *n in rows_of(duck, usage.COUNTS):
        for key in (name if n[3] >= 10 and name else "Other languages", ""):
            true[key] = [x + y for x, y in zip(true[key], n, strict=True)]
    shown = {(r[0], c): int(x) for r in found for c, x in enumerate(r[1:]) if x.isdigit()}
    cells = {(r[0], c): x for r in found for c, x in enumerate(r[1:])}
    assert {r[0] for r in found} == set(true) and all(true[k][c] == v >= 10 for (k, c), v in shown.items())
    assert all((x == "<10") == (true[k][c] < 10) for (k, c), x in cells.items())

    def gives_away(table):
        for k in true:  # a part and its whole: booked of viewed, and so on
            for whole, part in ((1, 0), (3, 2), (3, 1), (2, 0)):
                if (k, whole) in table and (k, part) in table and table[k, whole] - table[k, part] < 10:
                    return True
        for c in range(4):  # a total and all but what is hidden of its column
            rest = [k for k in true if k and (k, c) not in table]
            if ("", c) in table and rest and (len(rest) == 1 or sum(true[k][c] for k in rest) < 10):
                return True
        return False

    assert not gives_away(shown)
    return found


def brute_lines_on_photo(duck, found):
    """Short documents: every clause against the whole damaged copy, cell by cell; numbers of words of the others."""
    import unicodedata

    from test_alignment import brute

    def norm(w):
        t = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
        return "".join(c for i, c in enumerate(t) if c.isalnum() or c in ".,/:-" and 0 < i < len(t) - 1 and t[i - 1].isdigit() and t[i + 1].isdigit())

    def damaged(t):
        for n, line in enumerate(t.split("\n")):
            for i, w in enumerate(line.split()):
                if (i + n) % 13 != 5:
                    yield from (w[:3] + "x" + w[4:] if (i + n) % 7 == 3 and len(w) >= 8 else f"{w} ~ zz" if (i + n) % 17 == 4 else w).split(" ")

    of = collections.defaultdict(dict)
    for r in found:
        of[r[0]][r[1]] = r
    out = []
    for d, t in texts(duck).items():
        clauses = [m for m in re.finditer(r"[^\n.!?|]+[.!?|]*", t) if m.group().strip()]
        assert sorted(of.get(d, {})) == list(range(len(clauses)))
        if len(t) > 900 or re.search(r"-\s*\n", t):
            out += of[d].values()
            continue
        ours = [(norm(m.group()), *m.span()) for m in re.finditer(r"\S+", t) if norm(m.group())]
        raw = list(damaged(t))
        read = [(norm(w), i) for i, w in enumerate(raw) if norm(w)]
        names = [w for w, _, _ in ours]
        for pos, m in enumerate(clauses):
            inside = [i for i, (_, a, b) in enumerate(ours) if a >= m.start() and b <= m.end()]
            a, n = (inside[0], len(inside)) if inside else (sum(x[1] < m.start() for x in ours), 0)
            same = [i for i in range(len(names) - n + 1) if n and names[i : i + n] == names[a : a + n]]
            got = brute([w for w, _ in read], names[a : a + n], (sum(i < a for i in same), len(same)), a / max(1, len(ours)))
            out.append((d, pos, got, None, None, None, n) if isinstance(got, str) else (d, pos, "found", read[got[0]][1], read[got[1]][1], got[2], n))
    return out


def events(duck):
    by = collections.defaultdict(list)
    for u, e, k, t in rows_of(duck, "SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 FROM events ORDER BY user_id, ts, event_id"):
        by[u].append((e, k, t))
    return by


def brute_paper_languages(duck, found):
    """The rules one after another over each whole text; words and letters by another engine's classes."""
    import regex

    en, es, other = (set(x.split()) for x in (languages.CHECKED["en"], languages.CHECKED["es"], languages.UNCHECKED))
    words = lambda t: regex.findall(r"\p{L}+", t.lower())
    out = []
    for key, text in rows_of(duck, "SELECT doc_id, coalesce(text, '') FROM documents"):
        letters, all_ = len(regex.findall(r"\p{L}", text)), words(text)
        n_en, n_es, n_other = (sum(w in some for w in all_) for some in (en, es, other))
        long = [words(text[a:b]) for a, b in coverage.sentences_of(text)]
        long = [w for w in long if len(w) >= 5]
        bare = sum(not any(x in en | es for x in w) for w in long)
        ok = letters > 0 and len(regex.findall(r"\p{Script=Latin}", text)) >= 0.95 * letters and sum(c in languages.VIETNAMESE for c in text.lower()) <= 0.01 * letters
        ok = ok and n_en + n_es + n_other > 0 and (n_other < 3 or n_other <= 0.2 * (n_en + n_es + n_other))
        ok = ok and not any(sum(x in other for x in w) > sum(x in en | es for x in w) for w in long) and (bare <= 1 or bare <= 0.2 * len(long))
        there = [k for k, n in (("en", n_en), ("es", n_es)) if n >= 3 and n >= 0.06 * len(all_)]
        out.append((key, ",".join(there) if ok and there else None))
    return out


def brute_sliding_rate_limit(duck, found):
    out = []
    for u, es in events(duck).items():
        taken = []
        for e, _, t in es:
            ok = sum(t - x < 36_000 for x in taken) < 3
            taken += [t] * ok
            out.append((u, e, ok))
    return out


def brute_ttl_counter(duck, found):
    out = []
    for u, es in events(duck).items():
        begin, used = None, 0
        for e, _, t in es:
            if begin is None or t >= begin + 86_400:
                begin, used = t, 0
            out.append((u, e, used < 2))
            used += used < 2
    return out


def brute_call_sessions(duck, found):
    order, out = ["placed", "ringing", "talking", "end"], []
    for u, es in events(duck).items():
        at, status, tries, ends = None, "", 0, 0
        for e, k, t in es:
            kind = usage.KINDS[k]
            why = "applied"
            if kind == "start":
                if at is not None and t < ends and at < 3:
                    why = "already_live"
                else:
                    at, status, tries, ends = 0, "placed", 0, t + 86_400
            elif at is None:
                why = "unknown"
            elif t >= ends:
                why = "stale"
            elif at == 3:
                why = "finished"
            elif kind == "attempt":
                why = "applied" if tries < 3 else "too_many"
                tries = min(3, tries + 1)
            else:
                place = order.index("end" if kind in ("done", "failed") else kind)
                if place > at:
                    at, status = place, kind
                else:
                    why = "no_move"
            out.append((u, e, status, tries, why))
    return out


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_equals_brute_force(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    wanted = globals()[f"brute_{name}"](duck, found)
    assert found and plain(found, range(len(df.columns))) == plain(wanted, range(len(df.columns)))
