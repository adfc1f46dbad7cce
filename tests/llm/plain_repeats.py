"""Repeated lines and passages by their definition, on one machine and by the words themselves."""

from lodgeframe.llm.unit_dedup import SENTENCE, UNSPACED


def sentences_of(text):
    """(starts a line, ends one, begin, end, words) of each; the end is where the next one begins or the line ends."""
    out, at = [], 0
    for line in text.split("\n"):
        found = [m.span() for m in SENTENCE.finditer(text, at, at + len(line))]
        for n, (a, b) in enumerate(found):
            first, last = n == 0, n == len(found) - 1
            out.append((first, last, at if first else a, at + len(line) if last else found[n + 1][0], tuple(text[a:b].lower().split())))
        at += len(line) + 1
    return out


def units(text, min_words, passage):
    """(starts a line, ends one, begin, end, words) of long lines and of runs of sentences that no shorter run could stand for."""
    out, at = set(), 0
    for line in text.split("\n"):
        words = tuple(line.lower().split())
        if len(words) >= min_words or len(UNSPACED.findall(line)) >= 2 * min_words:
            out.add((True, True, at, at + len(line), words))
        at += len(line) + 1
    parts = sentences_of(text)
    size = lambda i, j: sum(len(p[4]) for p in parts[i:j])
    for i in range(len(parts)):
        for j in range(i + 1, len(parts) + 1):
            # the shortest that begins with i, or the shortest that ends before j
            if size(i, j) >= passage and (size(i, j - 1) < passage or size(i + 1, j) < passage):
                out.add((parts[i][0], parts[j - 1][1], parts[i][2], parts[j - 1][3], sum((p[4] for p in parts[i:j]), ())))
    return sorted(out, key=lambda u: u[2])


def without_repeats(rows, min_words=5, passage=50):
    """For (doc_id, text) of different ids: the text that is left and the offsets of what went."""
    earliest, out = {}, {}
    for doc_id, text in sorted(rows):
        seen, gone = {}, []
        for starts, ends, a, b, words in units(text, min_words, passage):
            if earliest.get(words, doc_id) < doc_id or a >= seen.setdefault(words, b):
                gone.append((a, b, starts, ends))
        for words in seen:
            earliest.setdefault(words, doc_id)
        # what touches is one; whole lines take the line break along
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
        kept += ended[at:]
        out[doc_id] = kept[:-1], [(a, min(b + (starts and ends), len(text))) for a, b, starts, ends in spans]
    return out
