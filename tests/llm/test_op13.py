"""Personal data: the contract's expressions and the bootstrapping in plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from helpers import documents, fixture_rows, prose

from tandem.llm.op13_pii import KINDS, Settings, found_places, learned, personal_data, report

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GAP = "[\x20\x09-\x0d]"
WORD = "[^\x20\x09-\x0d]"
SHAPES = {
    "email": lambda s: re.fullmatch(r"[^@]+@[^@]+", s) or re.search(r"[(\[]at[)\]]", s),
    "ip": lambda s: re.fullmatch(r"[0-9a-f]+([.:]+[0-9a-f]*){3,}", s),
    "card": lambda s: re.fullmatch(r"[0-9]([ -]?[0-9]){11,}", s),
    "phone": lambda s: re.fullmatch(r"[+()0-9 ./-]+", s) and 7 <= len(re.sub("[^0-9]", "", s)) <= 15,
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def context(left, right):
    norm = lambda t: ["#" if re.search("[0-9@]", w) else w for w in re.findall(WORD + "+", t.lower())]
    return norm(re.sub(r"""["'(<\[{]+$""", "", left)), norm(re.sub(r"""^["')>\]},;:.!?]+""", "", right))


def places(text):
    """(kind or None, start, end, surface, w2, w1, w3)"""
    spans = base_spans(text)
    out = []

    def add(kind, start, end, left, right, edge):
        before, after = context(left[-160:], right[:160])
        word = lambda n: before[-n] if len(before) >= n else edge
        out.append((kind, start, end, text[start:end].lower(), word(2), word(1), after[0] if after else "^"))

    for k, kind in enumerate(KINDS):   # gaps between all matches of the kind's expression
        found = list(re.finditer(BASE[kind], text))
        if kind == "card":             # of other lengths are no matches in the operator
            found = [m for m in found if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
        for i, m in enumerate(found):
            if (m.start(), k, m.end()) in spans:
                left = text[found[i - 1].end() if i else 0:m.start()]
                right = text[m.end():found[i + 1].start() if i + 1 < len(found) else len(text)]
                add(k, m.start(), m.end(), left, right, "^")
    sign = f"[^\x20\x09-\x0d0-9@]*[0-9@]{WORD}*"
    runs = list(re.finditer(f"(?<!{WORD}){sign}(?: {sign})*", text))
    for i, m in enumerate(runs):
        if any(a < m.end() and b > m.start() for a, _, b in spans):
            continue
        left = text[runs[i - 1].end() if i else 0:m.start()][-160:]
        right = text[m.end():runs[i + 1].start() if i + 1 < len(runs) else len(text)]
        lead = re.match(r"""(?:[A-Za-z_]+[:=])?["'<\[{,;:!?]*""", m.group()).group()
        core = re.sub(r"""["'>\]},;:.!?]+$""", "", m.group()[len(lead):])
        if core:
            before, after = context(left + lead, right[:160])
            edge = "#" if i else "^"
            word = lambda n: before[-n] if len(before) >= n else edge
            start = m.start() + len(lead)
            out.append((None, start, start + len(core), core.lower(), word(2), word(1), after[0] if after else "^"))
    return out


def brute_learned(texts, s):
    edges = defaultdict(dict)
    for text in set(texts):
        for kind, _, _, surface, w2, w1, w3 in places(text or ""):
            names = [f"before {w2} {w1}"] if w1 not in "#^" else []
            names += [f"around {w1} {w3}"] if w1 not in "#^" and w3 not in "#^" else []
            for p in names:
                old = edges[p].get(surface)
                edges[p][surface] = kind if old is None else old if kind is None else min(old, kind)
    fits = lambda surface, k: bool(SHAPES[KINDS[k]](surface))
    accepted = {}
    for _ in range(s.rounds):
        misses = defaultdict(list)
        for surfaces in edges.values():
            for k in range(4):
                label = {x: accepted.get(x) if seed is None else seed for x, seed in surfaces.items()}
                pos = sum(v == k for v in label.values())
                neg = sum(v != k if v is not None else not fits(x, k) for x, v in label.items())
                if pos >= s.min_seeds and pos / (pos + neg) >= s.min_confidence:
                    for x, seed in surfaces.items():
                        if seed is None and fits(x, k):
                            misses[x, k].append(1 - pos / (pos + neg))
        best = {}
        for (x, k), rest in misses.items():
            score = 1 - math.prod(rest)
            if score >= s.accept and (x not in best or (score, -k) > best[x]):
                best[x] = (score, -k)
        now = {x: -k for x, (_, k) in best.items()}
        if len(now) <= len(accepted):
            break
        accepted = now
    return accepted


def brute(rows, s=Settings()):
    known = brute_learned([r[1] or "" for r in rows], s)
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        base = base_spans(text)
        spans = sorted(base + [(a, known[x], b) for kind, a, b, x, *_ in places(text) if kind is None and x in known])
        write = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
        out.append((doc_id, *(sum(k == i for _, k, _ in base) for i in range(4)),
                    hashlib.sha256(write(base).encode()).hexdigest(), write(spans)))
    return out, known


EXTRA = [
    "a@b.c%d@e.f a@b..c x@y a@b.c.%x@y.z é@ü.de mailto:Joe.Doe+x@mail-1.example.com,", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111111111111111", "5 6 7--8 41 1111 11 11 11 1111 1",
    "+1 (743) 555-3824 +12 +123456789 + 1 +1 ( 743 ) 555 3824. 1+1+1234567890123456", "0000000000000000 000000000000 0000-0000-0000",
    "🙂 x@y.zz 漢字 1.1.1.1", "@ @@ 1@ @1 1@1.1", "a" * 3000 + "@" + "b." * 3000 + "c", "1" * 4000 + " " + "1 " * 3000, "x" * 200 + " 1.2.3.4 " + "y" * 200,
    "\t1.2.3.4\n5.6.7.8\r\n", "(1.2.3.4) [a@b.cc] <+1 743 555 3824>", "+1" * 500, "....9" + "." * 4000 + "x", "1.1.1.1" * 50]


def planted(seed=6):
    """Contexts that hold seeds of one kind and identifiers no expression knows, and contexts that mix kinds."""
    rng = random.Random(seed)
    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    email = lambda: f"u{rng.randint(0, 10 ** 6)}@mail.example.com"
    rows, i = [], 300
    for _ in range(14):
        rows.append(f"{prose(rng, 30)} call me at +1 {phone()} today {prose(rng, 9)}")
        rows.append(f"{prose(rng, 30)} the server host {ip()}, {prose(rng, 9)}")
        rows.append(f"{prose(rng, 9)} seen near {rng.choice([ip, email, lambda: '+1 ' + phone()])()} there {prose(rng, 5)}")
    rows += [f"{prose(rng, 12)} call me at {phone()}. {prose(rng, 4)}", f"and server host fe80::1:2:3 {prose(rng, 3)}",
             f"{prose(rng, 5)} server host 12 {prose(rng, 3)}", f"{prose(rng, 5)} seen near {phone()} there"]
    secret = phone()     # known from the first context, carries the second, which knows another
    rows += [f"{prose(rng, 5)} call me at {secret} now", f"ring number {secret} today"]
    rows += [f"{prose(rng, 3)} ring number +1 {phone()} again" for _ in range(4)] + [f"to ring number {phone()} please", f"again {secret}"]
    return [(i + k, t, "en", "s", len(t)) for k, t in enumerate(rows)]


def rows_of_test():
    return (fixture_rows() + [(200 + i, t, None, None, None) for i, t in enumerate(EXTRA)] + planted()
            + [(None, EXTRA[0], None, None, None)] * 2)


def test_against_brute_force(spark):
    rows = rows_of_test()
    want, known = brute(rows)
    assert len(known) >= 4
    got = sorted(map(tuple, report(personal_data(documents(spark, rows))).collect()), key=str)
    assert got == sorted(want, key=str)


def test_discovers_unseen_identifiers(spark):
    found = report(personal_data(documents(spark, planted())))
    more = [r for r in found.collect() if len([x for x in r["spans"].split(",") if x]) > sum(r[f"n_{k}"] for k in KINDS)]
    assert len(more) == 6     # the ambiguous context gives none, nor does the number 12
    assert learned(found_places(documents(spark, fixture_rows()))[1]) is None


def test_mixed_settings(spark):
    s = Settings(min_seeds=2, min_confidence=0.5, accept=0.6)
    rows = rows_of_test()
    got = sorted(map(tuple, report(personal_data(documents(spark, rows), s)).collect()), key=str)
    assert got == sorted(brute(rows, s)[0], key=str)


def test_empty_table(spark):
    assert report(personal_data(documents(spark).where("false"))).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_signs(spark, seed):
    """Base spans of texts made of few signs, where the expressions meet most edges."""
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("01239 ..-+()@ab\n%") for _ in range(rng.randint(1, 120))), None, None, None) for i in range(150)]
    rows += [(1000 + i, "".join(rng.choice("0127 -+") for _ in range(60)), None, None, None) for i in range(150)]
    got = sorted(map(tuple, report(personal_data(documents(spark, rows))).collect()), key=str)
    assert got == sorted(brute(rows)[0], key=str)


def test_native(spark):
    plan = personal_data(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[-1].replace("LogicalRDD", ""))
