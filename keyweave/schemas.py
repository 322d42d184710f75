"""The relations of the engine, one fixed schema for each abstraction.

Keys are strings, everything stored is binary, and absence is null.  ``now`` is never
read from a clock: whoever asks about expiry passes it.
"""

from __future__ import annotations

KV = "key string, value binary, expires_at_ms long"
HASH = "key string, field string, value binary"
LIST = "key string, idx long, value binary"
SET = "key string, member binary"
ZSET = "key string, member binary, score double"
BITMAP = "key string, offset long"
SKETCH = "key string, sketch binary"
GEO = ZSET
ROOM = "room string, offset long, id string, event string, data binary, ts timestamp, metadata map<string,string>"
CURSOR = "room string, subscriber string, last_offset long"
TOPIC = "topic string, partition_id int, offset long, key binary, event string, data binary, ts timestamp, size_bytes long"
GROUP_OFFSET = "group_id string, partition_id int, offset long, seq long"
MESSAGE = "queue string, id string, payload binary, priority int, retry_count int, max_retries int, state string, consumer_id string, ack_deadline long, place long"
SUBSCRIPTION = "subscriber_id string, pattern string"
OPLOG = "seq long, ts_ms long, op string, key string, member binary, value binary, num double, args map<string,string>"
