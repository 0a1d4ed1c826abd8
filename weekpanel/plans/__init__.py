"""The composite jobs: operators put together in the order that needs the fewest wide shuffles."""
