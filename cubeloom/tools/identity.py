"""Who is asking: claims of an already verified identity as an AuthContext."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from cubeloom.errors import AuthError
from cubeloom.model import AuthContext


@dataclass(frozen=True)
class ClaimMap:
    """Which claims hold what; roles may be a list or words in a string."""

    viewer_id: str = "sub"
    tenant: str = "tenant"
    roles: str = "roles"

    def context(self, claims: Mapping[str, Any]) -> AuthContext:
        viewer = claims.get(self.viewer_id)
        if not viewer or not isinstance(viewer, str):
            raise AuthError(f"the identity has no {self.viewer_id!r}", reason="claims")
        roles = claims.get(self.roles, ())
        roles = roles.split() if isinstance(roles, str) else roles
        if not all(isinstance(r, str) for r in roles):
            raise AuthError("a role is a string", reason="claims")
        tenant = claims.get(self.tenant)
        if tenant is not None and not isinstance(tenant, str):
            raise AuthError("a tenant is a string", reason="claims")
        rest = {k: v for k, v in claims.items() if k not in (self.viewer_id, self.tenant, self.roles)}
        return AuthContext(viewer_id=viewer, tenant=tenant, roles=tuple(roles), attrs=rest)


def from_dict(claims: Mapping[str, Any], mapping: ClaimMap | None = None) -> AuthContext:
    return (mapping or ClaimMap()).context(claims)


def _decode(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def from_hmac_token(token: str, secret: bytes, *, mapping: ClaimMap | None = None, audience: str | None = None, now: float | None = None, leeway: float = 30.0) -> AuthContext:
    """Claims of a compact token signed with HMAC-SHA256; any other algorithm is refused."""
    try:
        head, body, signature = token.split(".")
        header, claims, given = json.loads(_decode(head)), json.loads(_decode(body)), _decode(signature)
    except ValueError as e:
        raise AuthError("the token is damaged", reason="token") from e
    if not isinstance(header, dict) or header.get("alg") != "HS256":
        raise AuthError("the token is not signed with HS256", reason="algorithm")
    if not hmac.compare_digest(hmac.new(secret, f"{head}.{body}".encode(), hashlib.sha256).digest(), given):
        raise AuthError("the token's signature is wrong", reason="signature")
    at = time.time() if now is None else now
    if not isinstance(claims.get("exp"), int | float) or claims["exp"] + leeway < at:
        raise AuthError("the token has expired or names no expiry", reason="expired")
    if isinstance(claims.get("nbf"), int | float) and claims["nbf"] - leeway > at:
        raise AuthError("the token is not valid yet", reason="not_before")
    if audience is not None:
        audiences = claims.get("aud")
        if audience not in ([audiences] if isinstance(audiences, str) else audiences or ()):
            raise AuthError("the token is for another audience", reason="audience")
    return from_dict(claims, mapping)
