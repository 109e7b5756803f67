SELECT count(*) AS failures_last_24h
FROM {facts}
WHERE timestamp BETWEEN CAST(:report_ts AS TIMESTAMP) - make_interval(0, 0, 0, 0, 24)
                    AND CAST(:report_ts AS TIMESTAMP)
