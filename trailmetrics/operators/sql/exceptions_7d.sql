SELECT failure_type, count(*) AS count
FROM {facts}
WHERE timestamp BETWEEN CAST(:report_ts AS TIMESTAMP) - make_interval(0, 0, 0, 7)
                    AND CAST(:report_ts AS TIMESTAMP)
GROUP BY failure_type
ORDER BY count DESC, failure_type ASC NULLS LAST
