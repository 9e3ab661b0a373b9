"""The ledger's rules as a plain sequential fold, written without Spark."""


class Fold:
    def __init__(self):
        self.maps, self.rc, self.birth, self.freed, self.outcomes = {}, {}, {}, [], []

    def _add(self, lsn, pba, d):
        before = self.rc.get(pba, 0)
        self.rc[pba] = before + d
        assert self.rc[pba] >= 0
        if not before and d > 0:
            self.birth[pba] = lsn
        if before and not self.rc[pba]:
            self.freed.append((lsn, pba))
            return True
        return False

    def apply(self, lsn, op, vol, lba, value=None, guard=None):
        """value: (pba, salt). Returns whether it was applied."""
        if guard and self.rc.get(guard[0], 0) < guard[1]:
            return False
        prev = self.maps.get((vol, lba))
        if op == "L2pDelete":
            self.maps.pop((vol, lba), None)
            value = None
        else:
            self.maps[vol, lba] = value
        net = {}
        if prev != value:
            if prev:
                net[prev[0]] = net.get(prev[0], 0) - 1
            if value:
                net[value[0]] = net.get(value[0], 0) + 1
        gone = [p for p, d in net.items() if d and self._add(lsn, p, d)]
        self.outcomes.append((lsn, prev, gone[0] if gone else None))
        return True
