"""Area under the ROC curve."""


def auc(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in range(i, j):
            ranks[order[k]] = (i + j + 1) / 2
        i = j
    n1 = sum(labels)
    n0 = len(labels) - n1
    return (sum(r for r, y in zip(ranks, labels) if y) - n1 * (n1 + 1) / 2) / (n1 * n0)
