"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .shard import SHARDS, TABLE_SIZE

SQL: dict[str, str] = {}

# Turn-taking: each step of the recursion gives one slot to the shard whose turn it is.
_HASH = "('0x' || substr(md5({x} || '{salt}'), 1, 15))::BIGINT"
SQL["op6_sharding"] = f"""
WITH RECURSIVE shards AS (
  SELECT unnest([{', '.join(f"'{s}'" for s in SHARDS)}]) AS shard, unnest(range({len(SHARDS)})) AS who
), prefs AS (
  SELECT who, list_transform(range({TABLE_SIZE}), lambda j: ({_HASH.format(x='shard', salt='/offset')} % {TABLE_SIZE}
      + j * ({_HASH.format(x='shard', salt='/skip')} % ({TABLE_SIZE} - 1) + 1)) % {TABLE_SIZE}) AS pref
  FROM shards
), fill AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, list_filter(pref, lambda s: NOT list_contains(taken, s))[1])
  FROM fill JOIN prefs ON who = turn % {len(SHARDS)} WHERE turn < {TABLE_SIZE}
), owner AS (
  SELECT unnest(taken) AS slot, unnest(range({TABLE_SIZE})) % {len(SHARDS)} AS who
  FROM fill WHERE turn = {TABLE_SIZE}
)
SELECT doc_id, source, CAST(o.slot AS INTEGER) AS slot, shard
FROM documents d
JOIN owner o ON o.slot = {_HASH.format(x="coalesce(CAST(doc_id AS VARCHAR), '')", salt='/key')} % {TABLE_SIZE}
JOIN shards USING (who)"""
