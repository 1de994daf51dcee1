"""Cut a chat text into blocks that begin and end between messages.

Used inside tasks on byte streams.  A byte range owns the messages that begin
inside it, so a file of any size is read by many tasks and every message by
exactly one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# A message start right after a line end, on bytes.  It may miss exotic starts;
# then the text just stays in the block before it.
_START = re.compile(
    rb"(?<=[\r\n])[ \t]*(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}[, ]|\[[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"
)
_TAIL = 64  # longer than any start


def _start_from(buffer: bytes, at: int) -> int | None:
    for hit in _START.finditer(buffer):
        if hit.start() >= at:
            return hit.start()
    return None


def _last_start(buffer: bytes) -> int | None:
    found = None
    for hit in _START.finditer(buffer):
        found = hit.start()
    return found


def message_blocks(
    stream, origin: int, first: int, last: int | None, size: int
) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) blocks of the messages that begin in [first, last).

    ``stream`` is positioned at ``origin``, which is ``first`` or one byte
    before it.  The range at 0 also owns whatever precedes the first message.
    ``last=None`` reads to the end.
    """
    buffer, base = b"", origin
    started = first == 0
    while True:
        chunk = stream.read(size)
        buffer += chunk
        if not started:
            hit = _start_from(buffer, first - base)
            if hit is None:
                if not chunk or (last is not None and base + len(buffer) >= last + _TAIL):
                    return
                drop = max(0, len(buffer) - _TAIL)
                buffer, base = buffer[drop:], base + drop
                continue
            if last is not None and base + hit >= last:
                return
            buffer, base, started = buffer[hit:], base + hit, True
        if last is not None and base + len(buffer) > last:
            stop = _start_from(buffer, max(last - base, 1))
            if stop is not None:
                yield base, buffer[:stop]
                return
        if not chunk:
            if buffer:
                yield base, buffer
            return
        if len(buffer) >= size:
            cut = _last_start(buffer)
            if cut and (last is None or base + cut < last):
                yield base, buffer[:cut]
                buffer, base = buffer[cut:], base + cut
