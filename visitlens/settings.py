"""Deployment settings: the sites, addresses and path topics the reports are scoped to."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Values that belong to one installation.

    Host names are placeholders under the reserved ``example`` domains; an installation passes
    its own. Addresses, keyword and path lists are the fixed values the reports are defined on.
    """

    # Funnel sites from first to last stage.
    funnel_sites: tuple[str, ...] = ("guide.example.org", "directory.example.org", "booking.example.com")
    # Site whose traffic can be narrowed to topic paths.
    topic_site: str = "booking.example.com"
    # Further hosts loaded by the historical scan.
    console_sites: tuple[str, ...] = ("console.example.net",)
    # Hosts dropped at ingestion.
    excluded_sites: tuple[str, ...] = ("intranet.example.net", "old.example.net", "www.old.example.net")

    # Addresses left out of reports and of ingestion.
    excluded_ips: tuple[str, ...] = ("184.82.29.117", "123.25.101.101")
    # Addresses of the behaviour review.
    reviewed_ips: tuple[str, ...] = (
        "172.207.9.124",
        "40.113.19.56",
        "218.104.149.184",
        "48.210.57.6",
        "172.192.8.227",
        "130.33.64.66",
        "172.192.26.78",
        "171.120.26.145",
        "146.70.76.58",
        "50.24.28.220",
    )
    home_ips: tuple[str, ...] = ("184.82.29.117",)
    home_subnets: tuple[str, ...] = ("2405:9800:b911:2816::/64",)

    # Topic patterns, case-insensitive then case-sensitive.
    topic_ilike: tuple[str, ...] = ("%dementia%", "%memory%")
    topic_like: tuple[str, ...] = (
        "/topics/dementia-care.html",
        "/posts/thailand-dementia-memory-care.html",
        "/data%dementia%",
        "/data-output%dementia%",
    )

    # Fixed value: days of events kept.
    retention_days: int = 90

    def with_www(self, sites: tuple[str, ...]) -> tuple[str, ...]:
        return sites + tuple(f"www.{s}" for s in sites)

    @property
    def report_hosts(self) -> tuple[str, ...]:
        """Hosts of the timeline: every funnel site with and without ``www.``."""
        return self.with_www(self.funnel_sites)

    @property
    def listed_hosts(self) -> tuple[str, ...]:
        """Hosts the historical scan keeps."""
        return self.with_www(self.funnel_sites + self.console_sites)


DEFAULT = Settings()
