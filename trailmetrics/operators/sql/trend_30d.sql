-- The calendar has one row per day, so days without failures show zero. The window opens
-- within the day before the first calendar day; that partial day finds no partner.
-- per_day holds at most 31 days whatever the size of the facts: safe to broadcast.
WITH calendar AS (
    SELECT explode(sequence(
        CAST(CAST(:report_ts AS TIMESTAMP) - make_interval(0, 0, 0, 29) AS DATE),
        CAST(CAST(:report_ts AS TIMESTAMP) AS DATE),
        INTERVAL 1 DAY
    )) AS date
),
per_day AS (
    SELECT CAST(timestamp AS DATE) AS date, count(*) AS failures
    FROM {facts}
    WHERE timestamp BETWEEN CAST(:report_ts AS TIMESTAMP) - make_interval(0, 0, 0, 30)
                        AND CAST(:report_ts AS TIMESTAMP)
    GROUP BY ALL
)
SELECT /*+ BROADCAST(per_day) */ date, coalesce(per_day.failures, 0) AS failures
FROM calendar LEFT JOIN per_day USING (date)
ORDER BY date
