"""Page cursors: a URL-safe text that names the last row of a page and what it was a page of."""

from __future__ import annotations

import base64
import json
import re

VERSION, MAX_LENGTH = 1, 512
FIELDS = ("version", "inventory_id", "minimum_bytes", "size", "id")


def encode(inventory: str, minimum: int, size: int, id_: int) -> str:
    """The only text for these values."""
    body = json.dumps(dict(zip(FIELDS, (VERSION, inventory, minimum, size, id_))), separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode(token: str, inventory: str, minimum: int) -> tuple[int, int]:
    """Size and id of the last row, for a page of the same inventory and minimum; anything that ``encode`` would not have made is refused."""
    try:
        if len(token) > MAX_LENGTH:
            raise ValueError
        found = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        values = [found[f] for f in FIELDS]
        numbers = [values[0], *values[2:]]
        if any(type(n) is not int for n in numbers) or not isinstance(values[1], str) or encode(*values[1:]) != token:
            raise ValueError
    except (ValueError, KeyError, TypeError) as broken:
        raise ValueError("not a cursor") from broken
    version, known, least, size, id_ = values
    if version != VERSION or not re.fullmatch("[0-9a-f]{64}", known) or least < 0 or size < least or id_ <= 0:
        raise ValueError("not a cursor")
    if (known, least) != (inventory, minimum):
        raise ValueError("the cursor is of another inventory or minimum")
    return size, id_


#: Age that a page of findings has unless another is asked for; its cursors have a name of their own.
DEFAULT_AGE, MAX_AGE = 90, 36_500


def encode_finding(after: int, days: int = DEFAULT_AGE) -> str:
    """Where the next page of findings begins; pages of another age have other cursors."""
    return f"nm1:{after}" if days == DEFAULT_AGE else f"nm2:{days}:{after}"


def decode_finding(token: str, days: int = DEFAULT_AGE) -> int:
    """The last id of the page before; a cursor of another age, or one that ``encode_finding`` would not have made, is refused."""
    if not 1 <= days <= MAX_AGE:
        raise ValueError(f"days must be from 1 to {MAX_AGE}")
    found = re.fullmatch("([1-9][0-9]{0,18})", token.rpartition(":")[2])
    if not found or int(found[1]) >= 1 << 63 or encode_finding(int(found[1]), days) != token:
        raise ValueError("not a cursor of this age")
    return int(found[1])
