"""Handing one query over Arrow Flight: a server with a single ticket and its client."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    from pyarrow import flight
except ImportError:
    flight = None

#: Fixed value: the one ticket.
TICKET = b"orders"


if flight:

    class OrdersServer(flight.FlightServerBase):
        """Serves ``do_get`` for the ticket ``orders``; any other ticket is not found, any other call not implemented."""

        def __init__(self, df: DataFrame, location: str = "grpc://127.0.0.1:0"):
            super().__init__(location)
            self.df = df

        def do_get(self, context, ticket):
            if ticket.ticket != TICKET:
                raise flight.FlightServerError(f"not found: no such ticket: {ticket.ticket!r}")
            return flight.RecordBatchStream(self.df.toArrow())

    def fetch_orders(port: int, ticket: bytes = TICKET) -> pa.Table:
        with flight.connect(f"grpc://127.0.0.1:{port}") as client:
            return client.do_get(flight.Ticket(ticket)).read_all()
