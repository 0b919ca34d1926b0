from finpanel.streaming.loads import stream_upsert
