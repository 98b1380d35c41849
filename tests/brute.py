"""Plain single-machine versions of the operators, for comparison on small inputs."""

import difflib
import random
import re

WILD = "<*>"


def scores(known, message, n):
    equal = sum(k == m != WILD for k, m in zip(known, message)) / len(known)
    both = set(known) & set(message)
    either = set(known) | set(message)
    grams = [[tuple(x[i:i + n]) for i in range(len(x) + 1 - n)] for x in (known, message)]
    ratio = difflib.SequenceMatcher(None, *grams).ratio() if all(grams) else 0.0
    return {"seqDist": equal, "jaccard": len(both) / len(either), "ngram": ratio,
            "combined": max(equal, ratio, len(both) / len(either))}


def merge(message, known):
    keep = re.compile(r"[\s|\[\]{}()]")
    return [m if m == k or keep.match(m) else WILD for m, k in zip(message, known)]


def sequential(messages, method, st, n):
    """{line: cluster}, {cluster: tokens} for [(line, tokens)] in line order."""
    clusters, home = {}, {}
    for line, tokens in messages:
        rated = [
            (scores(known, tokens, n)[method], -cid) for cid, known in clusters.items() if len(known) == len(tokens)
        ]
        best = max([r for r in rated if r[0] >= st], default=None)
        if best is None:
            clusters[line] = list(tokens)
            home[line] = line
        else:
            home[line] = -best[1]
            clusters[home[line]] = merge(tokens, clusters[home[line]])
    return home, clusters


def leader(messages, method, st, n):
    """The same against the first message of each cluster, with a final choice among all earlier leaders."""
    first = {}
    for line, tokens in messages:
        first.setdefault(tuple(tokens), line)
    leaders = []
    for tokens, line in first.items():
        if not any(len(k) == len(tokens) and scores(k, tokens, n)[method] >= st for k, _ in leaders):
            leaders.append((tokens, line))
    own = dict(leaders)
    choice = {}
    for tokens, line in first.items():
        rated = [
            (scores(k, tokens, n)[method], -cid)
            for k, cid in leaders if len(k) == len(tokens) and cid < line
        ]
        best = max([r for r in rated if r[0] >= st], default=None)
        choice[tokens] = own[tokens] if tokens in own else -best[1]
    home = {line: choice[tuple(tokens)] for line, tokens in messages}
    merged = {}
    for line, tokens in messages:
        cid = home[line]
        merged[cid] = merge(tokens, merged[cid]) if cid in merged else list(tokens)
    return home, merged


def random_messages(seed, count, words=6):
    """Messages of a few shapes with random slots, brackets and masked words; tokens include the blanks."""
    rng = random.Random(seed)
    vocabulary = ["open", "close", "node", "disk", "(", "[x", WILD, "fail", "ok"]
    shapes = [[rng.choice(vocabulary) for _ in range(rng.randint(2, words))] for _ in range(8)]
    out = []
    for line in range(count):
        shape = list(rng.choice(shapes))
        for _ in range(rng.randint(0, 2)):
            shape[rng.randrange(len(shape))] = rng.choice(vocabulary + ["7", "8"])
        tokens = [t for word in shape for t in (word, " ")][:-1]
        out.append((line * 3 + 5, tokens))
    return out


def group_metrics(truth, parsed, wanted=None):
    rows = [(t, p) for t, p in zip(truth, parsed) if t is not None]
    in_scope = (lambda t: True) if wanted is None else (lambda t: t in wanted)
    lines = templates = 0
    touched = set()
    for label in {t for t, _ in rows}:
        mine = [p for t, p in rows if t == label]
        kinds = {p for p in mine if p is not None}
        if in_scope(label):
            touched |= kinds
        if len(kinds) == 1 and len(mine) == sum(p in kinds for _, p in rows) and in_scope(label):
            lines, templates = lines + len(mine), templates + 1
    n_truth = len({t for t, _ in rows}) if wanted is None else len(wanted)
    ga = lines / sum(in_scope(t) for t, _ in rows)
    pga, rga = templates / len(touched), templates / n_truth
    fga = 2 * pga * rga / (pga + rga) if pga + rga else 0.0
    right = identified = 0
    for text in {p for _, p in rows if p is not None}:
        labels = {t for t, p in rows if p == text}
        identified += any(in_scope(t) for t in labels)
        right += labels == {text} and in_scope(text)
    pta, rta = right / identified, right / n_truth
    fta = 2 * pta * rta / (pta + rta) if pta + rta else 0.0
    return {"GA": ga, "PGA": pga, "RGA": rga, "FGA": fga, "PTA": pta, "RTA": rta, "FTA": fta}


def correct(template):
    """Template correction, rule by rule and step by step."""
    text = " ".join(template.split())
    pieces = re.findall(r"""[\s,!;:=|"'\[\](){}.\-+@#$%&]|[^\s,!;:=|"'\[\](){}.\-+@#$%&]+""", text)
    text = "".join(WILD if p.isdigit() or (WILD in p and "/" not in p) else p for p in pieces)
    steps = [("<*>.<*>", WILD), ("<*><*>", WILD), (" #<*># ", " <*> "), (" #<*> ", " <*> ")]
    steps += [(f"<*>{c}<*>", WILD) for c in ":#/@."] + [(' "<*>" ', " <*> "), (" '<*>' ", " <*> "), ("<*><*>", WILD)]
    for old, new in steps:
        while old in text:
            text = text.replace(old, new, 1)
    return text
