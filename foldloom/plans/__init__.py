"""Distribution patterns shared by the operators: staging, global order, digests."""
