"""A small seeded corpus with known answers, for tests and demonstrations. Its numbers and names are invented."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

START = datetime(2025, 6, 1, tzinfo=timezone.utc)


def corpus(seed: int = 7, people: int = 8, calls: int = 90, payments: int = 30) -> dict:
    """A manifest: each person has a phone and an account; the last two records are one person under two spellings."""
    r = random.Random(seed)
    stamp = lambda minutes: (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    items, places, talks, pays = [], [], [], []
    add = lambda kind, ref, **content: items.append({"ref": ref, "sourceKey": "files", "itemType": kind, "content": {"recordRef": ref, **content}})
    for k in range(people):
        name = f"Person {chr(65 + k % 26)}{k}"
        add("suspect_record", f"suspect-{k}", name=name, role="member", phones=[f"+9900{k:04d}"], accounts=[f"SYN-AC-{k:06d}"], knownAliases=[f"Alias {k}"])
        add("phone_record", f"phone-{k}", number=f"+9900{k:04d}", imei=f"IMEI{k:05d}", subscriberName=name)
        add("bank_account_record", f"account-{k}", account=f"SYN-AC-{k:06d}", accountKind="savings", holderName=name)
    add("suspect_record", "twin", name="P. A-Zero", phones=["+99000000"])
    for k in range(6):
        ref = f"place-{k}"
        add("location_record", ref, label=f"Tower {k}", locationType="cell_tower", latitude=28.4 + k * 0.004, longitude=77.0 + k * 0.05)
        places.append({"ref": f"loc-{k}", "sourceRef": ref, "label": f"Tower {k}", "locationType": "cell_tower", "latitude": 28.4 + k * 0.004, "longitude": 77.0 + k * 0.05})
    for k in range(calls):
        a, b = r.sample(range(people), 2)
        at, tower = stamp(r.randrange(60 * 24 * 30)), r.randrange(6)
        add("cdr_event", f"call-{k}", callerNumber=f"+9900{a:04d}", calleeNumber=f"+9900{b:04d}", startedAt=at, durationSeconds=r.randrange(5, 900), cellTower=f"Tower {tower}")
        talks.append({"sourceRef": f"call-{k}", "callerPhone": f"+9900{a:04d}", "calleePhone": f"+9900{b:04d}", "occurredAt": at, "durationSeconds": 60, "cellLocationRef": f"loc-{tower}"})
    for k in range(payments):
        a = r.randrange(people - 1)
        at, amount = stamp(r.randrange(60 * 24 * 30)), float(r.randrange(100, 90_000))
        add("financial_transaction_record", f"pay-{k}", txnRef=f"T{k}", fromAccount=f"SYN-AC-{a:06d}", toAccount=f"SYN-AC-{a + 1:06d}", amount=amount, valueDate=at, currency="INR")
        pays.append({"sourceRef": f"pay-{k}", "amount": amount, "currency": "INR", "occurredAt": at})
    add("fir", "fir-1", accused=["Person A0", "Nobody Known"], firNumber="17/2025", filedAt=stamp(0))
    return {
        "corpus": {"name": "synthetic", "version": "1", "seed": seed, "generatedAt": stamp(0), "description": "invented"},
        "investigation": {"name": "sample", "status": "open"},
        "evidenceSources": [{"key": "files", "sourceType": "structured_dataset", "label": "Files"}],
        "evidenceItems": items, "locations": places, "communicationEvents": talks, "financialTransactions": pays,
    }


def write(path: str, **options) -> None:
    with open(path, "w") as f:
        json.dump(corpus(**options), f)
