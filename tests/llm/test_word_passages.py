import random

import pytest

from lodgeframe.llm.queries import queries
from lodgeframe.llm.unit_dedup import WORD, is_long, remove_repeats


def words_of(text):
    """(line, begin, end of the line, words of the line) of each line, and (number of its line, begin, word) of each word."""
    lines, words, at = [], [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        words += [(len(lines) - 1, at + m.start(), m.group().lower()) for m in WORD.finditer(line)]
        at += len(line) + 1
    return lines, words


def units_of(text, min_words, passage):
    """(start, stop, starts a line, ends one, words) of long lines and of each ``passage`` words on end."""
    lines, words = words_of(text)
    out = []
    for a, b, line in lines:
        own = line.lower().split()
        if is_long(line.lower(), own, min_words):
            out.append((a, b, True, True, tuple(own)))
    for i in range(len(words) - passage + 1):
        first, last = words[i], words[i + passage - 1]
        opens = i == 0 or words[i - 1][0] != first[0]
        closes = i + passage == len(words) or words[i + passage][0] != last[0]
        a = lines[first[0]][0] if opens else first[1]
        b = lines[last[0]][1] if closes else words[i + passage][1]
        out.append((a, b, opens, closes, tuple(w for *_, w in words[i : i + passage])))
    return sorted(out, key=lambda u: u[0])


def without_repeats(rows, min_words, passage):
    earliest, out = {}, {}
    for doc_id, text in sorted(rows):
        seen, gone = {}, []
        for a, b, starts, ends, words in units_of(text, min_words, passage):
            if earliest.get(words, doc_id) < doc_id or a >= seen.setdefault(words, b):
                gone.append((a, b, starts, ends))
        for words in seen:
            earliest.setdefault(words, doc_id)
        spans = []
        for a, b, starts, ends in sorted(gone, key=lambda g: (g[0], g[1], g[2] + 2 * g[3])):
            if spans and a <= spans[-1][1] + (spans[-1][2] and spans[-1][3]):
                if b >= spans[-1][1]:
                    spans[-1][1], spans[-1][3] = b, ends
            else:
                spans.append([a, b, starts, ends])
        kept, at, ended = "", 0, text + "\n"
        for a, b, starts, ends in spans:
            kept += ended[at:a]
            at = b + (starts and ends)
        out[doc_id] = (kept + ended[at:])[:-1], [(a, min(b + (starts and ends), len(text))) for a, b, starts, ends in spans]
    return out


def found(spark, rows, **how):
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    return {r["doc_id"]: (r["text"], [tuple(s) for s in r["removed_spans"]]) for r in got}


def test_passage_inside_of_a_sentence(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, f"It begins {passage} so it ends."), (2, f"Elsewhere there is {passage.upper()} too.\nnext"), (3, f"x {passage[:-7]} y")]
    got = found(spark, rows, min_words=50, passage=50)
    assert [got[d][0] for d in (1, 2, 3)] == [rows[0][1], "Elsewhere there is too.\nnext", rows[2][1]]


@pytest.mark.parametrize("seed", range(3))
def test_by_definition(spark, seed):
    drawn = random.Random(seed)
    pool = [" ".join(drawn.choices("abcdef", k=drawn.randrange(1, 9))) + drawn.choice([".", "!", "。", ""]) for _ in range(12)]
    rows = []
    for doc_id in range(80):
        text = "".join(drawn.choice(pool) + drawn.choice([" ", " ", "  ", "\n", "\n\n"]) for _ in range(drawn.randrange(12)))
        rows.append((doc_id, rows[-9][1] if doc_id % 10 == 9 else text))
    expected = without_repeats(rows, 4, 10)
    assert sum(bool(spans) for _, spans in expected.values()) > 30
    assert found(spark, rows, min_words=4, passage=10) == expected


def test_query_by_definition(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {
        d: (text, len(spans), ",".join(f"{a}-{b}" for a, b in spans)) for d, (text, spans) in without_repeats(rows, 50, 50).items()
    }
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["removed"]) for r in queries()["op1_substring_dedup"](spark, sf).collect()}
    assert got == expected
