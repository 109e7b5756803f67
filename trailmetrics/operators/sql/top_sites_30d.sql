SELECT site, count(*) AS failures
FROM {facts}
WHERE timestamp BETWEEN CAST(:report_ts AS TIMESTAMP) - make_interval(0, 0, 0, 30)
                    AND CAST(:report_ts AS TIMESTAMP)
GROUP BY site
ORDER BY failures DESC, site ASC NULLS LAST
LIMIT :k
