"""Plain one-group-at-a-time loops that the Spark plans must agree with."""

import math

from gistmill.functions.stemmer import stem
from gistmill.functions.wordlists import PUNCTUATION, STOP_WORDS

DROP = str.maketrans("", "", PUNCTUATION)


def bag_of(sentence, normalize=stem):
    words = sentence.translate(DROP).split()
    kept = [w for w in words if w not in STOP_WORDS]
    bag = {}
    for w in kept:
        bag[normalize(w)] = bag.get(normalize(w), 0) + 1
    return len(words), len(kept), bag


class Group:
    """Sentences of one group, in order."""

    def __init__(self, sentences, normalize=stem):
        self.texts = [s if s[-1] in PUNCTUATION else s + "." for s in sentences]
        self.described = [bag_of(s, normalize) for s in self.texts]
        self.counts = {}
        for _, _, bag in self.described:
            for term, tf in bag.items():
                self.counts[term] = self.counts.get(term, 0) + tf
        self.total = sum(n for _, n, _ in self.described)
        self.used = [False] * len(sentences)
        self.covered = set()

    def kl(self, i, topics=None, n_topics=None, v2=False):
        _, n, bag = self.described[i]
        if topics is not None and not (set(bag) & set(topics)):
            return None
        if n == 0:
            return 1000.0 if topics is None else None
        total = 0.0
        for term, tf in bag.items():
            if topics is not None and term not in topics:
                continue
            a, b = self.counts[term] / self.total, tf / n
            if topics is not None:
                b = b * (len(topics[term]) / n_topics)
            total += a * math.log(a / b) if a > 0 else 0.0
        if v2:
            mine = self.topics_of(i, topics)
            total = total * (n_topics / len(mine)) / 1.25 ** len(mine & self.covered)
        return total / n

    def topics_of(self, i, topics):
        return {x for term in self.described[i][2] for x in topics.get(term, ())}

    def tfidf(self, i):
        _, n, bag = self.described[i]
        if not bag:
            return 0.0
        total = 0.0
        for term, tf in bag.items():
            df = sum(term in other for _, _, other in self.described)
            idf = math.log2(len(self.texts) / df)
            if idf == 0:
                return None
            total += idf * math.log(idf / (tf / max(bag.values())))
        return total / n

    def pick(self, limit, by_sentences, level=0, method="kl", **topical):
        """Indices picked by repeated lowest score."""
        picked, taken = [], 0
        while taken < limit:
            scores = []
            for i in range(len(self.texts)):
                if self.used[i]:
                    scores.append(math.inf)
                    continue
                score = self.tfidf(i) if method == "tfidf" else self.kl(i, **topical)
                # Words-free sentences come only where nothing else was ever there.
                if score is None or (score == 1000.0 and any(self.used)):
                    score = math.inf
                scores.append(score)
            best = min(range(len(scores)), key=scores.__getitem__, default=None)
            if best is None or scores[best] == math.inf:
                break
            words, n, bag = self.described[best]
            if 5 <= words <= 29 and not (picked and self.texts[picked[-1]] == self.texts[best]):
                picked.append(best)
                taken += 1 if by_sentences else words
                if topical.get("v2"):
                    self.covered |= self.topics_of(best, topical["topics"])
            self.used[best] = True
            for term, tf in bag.items():
                if level == 1:
                    self.counts[term] -= tf
                elif level == 2:
                    self.counts[term] /= tf
            if level:
                self.total -= n
        return picked
