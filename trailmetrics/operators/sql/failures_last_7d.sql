SELECT count(*) AS failures_last_7d
FROM {facts}
WHERE timestamp BETWEEN CAST(:report_ts AS TIMESTAMP) - make_interval(0, 0, 0, 7)
                    AND CAST(:report_ts AS TIMESTAMP)
